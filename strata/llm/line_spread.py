"""Line dedup by distinct-site spread. Column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut

#: Parts into which the exact count deals each line's rows.
_SALTS = 8
_BLANK = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """``(id, h, site, at, k1, k2)`` for each line with a visible character; ``k1, k2`` hash the trimmed line."""
    parts = docs.select("id", "h", "site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    parts = parts.withColumn("line", F.btrim("line", F.lit(_BLANK))).where("line <> ''")
    return parts.select("id", "h", "site", "at", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def spread_lines(lines: DataFrame, min_sites: int, log_k: int = 12) -> DataFrame:
    """Keys ``(k1, k2, n_sites)`` of lines on ``min_sites`` or more distinct sites.

    One HyperLogLog sketch per line merges by aggregation. Estimates clearly above
    the threshold, by three standard errors and at least one site, stand; those
    as near below or above it give way to an exact distinct count of just these
    lines. A line on a third of all pages is a partial sketch per task.
    """
    margin = max(1.0, 3 * 1.04 / math.sqrt(1 << log_k) * min_sites)
    site = F.xxhash64("site")
    sketches = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg(site, log_k).alias("sketch"))
    estimated = cut(
        sketches.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("n_sites")).where(F.col("n_sites") >= min_sites - margin)
    )
    clear = estimated.where(F.col("n_sites") > min_sites + margin)
    near = estimated.where(F.col("n_sites") <= min_sites + margin)
    near = near.select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = lines.select("k1", "k2", "site", F.pmod(F.xxhash64("at", "id"), F.lit(_SALTS)).cast("int").alias("salt"))
    exact = (
        salted.join(near, ["k1", "k2", "salt"]).select("k1", "k2", "site").distinct()
        .groupBy("k1", "k2").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    )
    return clear.unionByName(exact)


def _prepared(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(text, F.length(text)).alias("h"),
        F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("")).alias("site"),
        text.alias("text"),
    )


def _spread_positions(docs: DataFrame, min_sites: int) -> DataFrame:
    """``(id, h, drop)``: per document, where its spread lines stand."""
    lines = _lines(docs)
    spread = cut(spread_lines(lines, min_sites))
    hits = lines.join(spread.select("k1", "k2"), ["k1", "k2"])
    return hits.groupBy("id", "h").agg(F.array_sort(F.collect_set("at")).alias("drop"))


def _cleaned(text: Column, drop: Column, max_loss: float | None) -> Column:
    """The lines at other places than ``drop`` (sorted), in time linear in the text; null if too much would go.

    Without ``max_loss``, too much is every line with a visible character.
    """
    gap = lambda at, before: F.concat(F.repeat(F.lit("0"), at - before - 1), F.lit("1"))
    flags = F.array_join(F.zip_with(drop, F.concat(F.array(F.lit(-1)), drop), gap), "")
    left = F.zip_with(F.split(text, "\n"), F.split(flags, ""), lambda line, flag: F.when(F.coalesce(flag, F.lit("0")) != "1", line))
    rest = F.array_join(left, "\n")  # without the nulls
    if max_loss is None:
        return F.when(F.btrim(rest, F.lit(_BLANK)) != "", rest)
    return F.when(F.length(rest) >= (1 - max_loss) * F.length(text), rest)


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
    max_loss: float | None = None,
) -> DataFrame:
    """``docs`` without the lines that stand on ``min_sites`` or more distinct sites.

    All rows and columns stay; only texts change. A document without any other
    visible line is a copy made of spread lines rather than a page with
    boilerplate: it stays whole, for near-duplicate removal to judge. With
    ``max_loss``, so does one that would lose more than that share of its
    characters.

    Lines are compared without surrounding ASCII white space; blank ones never
    count. A null site is one site of its own. Null texts stay null. Rows with
    equal id and text are treated alike, null ids included. An empty table gives
    an empty result.
    """
    positions = _spread_positions(_prepared(docs, id_col, text_col, site_col), min_sites)
    columns = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    text, key = F.col(f"_{columns.index(text_col)}"), F.col(f"_{columns.index(id_col)}")
    whole = F.coalesce(text.cast("string"), F.lit(""))
    keyed = own.withColumn("_h", F.xxhash64(whole, F.length(whole)))
    joined = keyed.join(positions, key.eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left")
    clean = F.when(F.col("drop").isNotNull(), F.coalesce(_cleaned(text, F.col("drop"), max_loss), text)).otherwise(text)
    return joined.select(*[(clean if i == columns.index(text_col) else F.col(f"_{i}")).alias(c) for i, c in enumerate(columns)])


def line_spread_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
    max_loss: float | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``(id, n_lines, n_spread, n_removed, n_chars_left, text_sha256)``.

    What :func:`remove_spread_lines` does to each text: its lines with a visible
    character, how many of them are spread, how many went, and the text that is
    left. A null text counts as empty.
    """
    own = _prepared(docs, id_col, text_col, site_col)
    positions = _spread_positions(own, min_sites)
    marked = own.alias("d").join(positions.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.h") == F.col("p.h")), "left")
    n_lines = F.size(F.filter(F.split("d.text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != ""))
    n_spread = F.coalesce(F.size("p.drop"), F.lit(0))
    clean = F.when(F.col("p.drop").isNotNull(), _cleaned(F.col("d.text"), F.col("p.drop"), max_loss))
    flat = marked.select(F.col("d.id").alias("id"), n_lines.alias("n_lines"), n_spread.alias("n_spread"), F.col("d.text").alias("text"), clean.alias("clean"))
    left = F.coalesce("clean", "text")
    return flat.select(
        F.col("id").alias(id_col),
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("n_spread").cast("bigint").alias("n_spread"),
        F.when(F.col("clean").isNull(), 0).otherwise(F.col("n_spread")).cast("bigint").alias("n_removed"),
        F.length(left).cast("bigint").alias("n_chars_left"),
        F.sha2(left, 256).alias("text_sha256"),
    )
