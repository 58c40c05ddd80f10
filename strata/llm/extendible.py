"""Sharding by extendible hashing: only shards over the byte limit split on another bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut, small

HASH_BITS = 60


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 digest of a value as text; null as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(h: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - bits).cast("int"))


def directory(rows: DataFrame, limit: int, known: int, bits: int) -> DataFrame:
    """For each ``bits``-bit prefix in use, the depth of its shard.

    ``rows`` has ``(group, h, n_bytes)``: one directory for each ``group``. From
    ``known`` bits on, buckets that exceed ``limit`` and hold more than one row are
    split on another bit, and only what they hold goes on; the work is on the
    histogram over prefixes. ``depth`` is null where even ``bits`` bits are not
    enough. Returns ``(group, entry, depth, shard_bytes, shard_rows)``.
    """
    prefix = _prefix(F.col("h"), bits).alias("entry")
    left = cut(rows.groupBy("group", prefix).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")))
    out = ["group", "entry", "depth", "shard_bytes", "shard_rows"]
    found = None
    for depth in range(known, bits + 1):
        at = left.withColumn("p", F.expr(f"shiftright(entry, {bits - depth})"))
        sums = cut(at.groupBy("group", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        over = small(cut(sums.where(~fits).select("group", "p")))
        whole = at.join(over, ["group", "p"], "left_anti").join(sums.where(fits), ["group", "p"])
        done = whole.withColumn("depth", F.lit(depth)).select(*out)
        found = done if found is None else found.unionByName(done)
        left = cut(at.join(over, ["group", "p"], "left_semi").select("group", "entry", "b", "n"))
        if left.isEmpty():
            break
    rest = left.select("group", "entry", F.lit(None).cast("int").alias("depth"), *[F.lit(None).cast("bigint").alias(c) for c in out[3:]])
    return found.unionByName(rest)


def _split(rows: DataFrame, limit: int, known: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their shard, and those that no number of bits can split (or None)."""
    done = None
    while True:
        sizes = rows.groupBy("group").agg(F.sum("n_bytes").alias("b")).agg(F.max("b").alias("b")).first()
        spread = math.ceil(math.log2(max(1, (sizes["b"] or 0) / limit))) + 6
        bits = min(HASH_BITS, known + spread)
        table = cut(directory(rows, limit, known, bits))
        joined = rows.withColumn("entry", _prefix(F.col("h"), bits)).join(table, ["group", "entry"])
        placed = joined.where("depth is not null").drop("entry")
        done = placed if done is None else done.unionByName(placed)
        if table.where("depth is null").isEmpty():
            return done, None
        rows = cut(joined.where("depth is null").select(*rows.columns))
        known = bits
        if known == HASH_BITS:
            return done, rows


def extendible_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 16 << 20) -> DataFrame:
    """Assign every row to a shard of at most ``limit`` UTF-8 bytes of text.

    Returns ``(id, n_bytes, prefix, depth, overflow, shard_bytes, shard_rows)``. A
    shard is the hash prefix (binary digits) of least depth whose rows fit the
    limit; shards that fit stay whole while others split, so depths differ as in a
    directory of extendible hashing. Only a row that alone exceeds the limit makes
    a larger shard, and it is alone there.

    Rows of one id share their hash. If an id's rows exceed the limit together,
    their chain is split in the same way by a hash of the row: ``overflow`` holds
    those binary digits, and is null elsewhere. Directory entries are some 64 times
    the number of shards, never the number of rows; they are joined, not collected.

    Null texts have 0 bytes. Null ids hash like empty text. Repeated rows are rows
    of one id. Other columns are ignored. An empty table gives an empty result.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("n_bytes"), hash60(F.col(id_col)).alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows.withColumn("group", F.lit(-1).cast("bigint")))

    def digits(h: Column) -> Column:
        return F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin(_prefix(h, F.col("depth"))), F.col("depth"), F.lit("0")))

    out = ["id", "n_bytes", "prefix", "depth", "overflow", "shard_bytes", "shard_rows"]
    placed, chained = _split(rows, limit)
    result = placed.select("*", digits(F.col("h")).alias("prefix"), F.lit(None).cast("string").alias("overflow")).select(*out)
    if chained is not None:
        again = cut(chained.select("id", "n_bytes", "row", F.col("h").alias("group"), hash60(F.col("row")).alias("h")))
        split, rest = _split(again, limit)
        if rest is not None:
            raise RuntimeError("two rows share 60 hash bits of their number")
        whole = F.lpad(F.bin(F.col("group")), HASH_BITS, "0")
        result = result.unionByName(
            split.select("*", whole.alias("prefix"), digits(F.col("h")).alias("overflow")).select(*out)
        )
    return result.withColumnRenamed("id", id_col)
