"""Packing by optimal length buckets and token-budget batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strata.session import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def optimal_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``histogram`` maps lengths to row counts. Each row is padded to its bucket's
    bound. Dynamic programming over the distinct lengths; as the cost of a last
    bucket ending at ``l`` is linear in ``l`` with falling slopes, each layer is a
    sweep along a lower hull. Exact integers; ties go to fewer, then lower bounds.
    """
    lengths = sorted(histogram)
    n = len(lengths)
    if not n:
        return []
    rows, tokens = [0], [0]
    for length in lengths:
        rows.append(rows[-1] + histogram[length])
        tokens.append(tokens[-1] + histogram[length] * length)
    best = [lengths[j - 1] * rows[j] - tokens[j] if j else 0 for j in range(n + 1)]
    cuts: list[list[int]] = []
    total = best[n]
    for _ in range(1, min(buckets, n)):
        hull: list[int] = []
        height = [best[i] + tokens[i] for i in range(n + 1)]

        def useless(a: int, b: int, c: int, height=height) -> bool:
            return (height[c] - height[a]) * (rows[b] - rows[a]) <= (height[b] - height[a]) * (rows[c] - rows[a])

        following, choice, at = [0] * (n + 1), [0] * (n + 1), 0
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) > 1 and useless(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and height[hull[at + 1]] - x * rows[hull[at + 1]] < height[hull[at]] - x * rows[hull[at]]:
                at += 1
            choice[j] = hull[at]
            following[j] = height[hull[at]] - x * rows[hull[at]] + x * rows[j] - tokens[j]
        cuts.append(choice)
        if following[n] >= total:
            cuts.pop()
            break
        best, total = following, following[n]
    bounds, j = [], n
    for choice in reversed(cuts):
        if j:
            bounds.append(lengths[j - 1])
            j = choice[j]
    if j:
        bounds.append(lengths[j - 1])
    return bounds[::-1]


def pack_by_length(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 16,
    batch_tokens: int = 16_384,
    chunks: int = 1_024,
    length: Column | None = None,
) -> DataFrame:
    """Assign every row a bucket and a batch that fits ``batch_tokens`` when padded.

    Returns ``(id, slice, n_tokens, bucket, bucket_len, batch, slot, padding)``.
    Lengths are word counts unless ``length`` gives others. A row longer than
    ``batch_tokens`` is cut into slices of that length and a last one, each a row of
    the result; ``slice`` numbers them from 0, and ``n_tokens`` is the slice's. The
    histogram of lengths (at most ``batch_tokens`` bins) goes to the driver, which
    chooses the bounds. Inside a bucket of bound ``L``, each ``batch_tokens // L``
    slices make a batch, the last one possibly fewer.

    Rows are numbered without gathering a bucket in one task: each bucket is dealt
    into ``chunks`` by a hash of the row, rows are numbered inside a chunk, and the
    chunks' sizes (at most ``chunks`` per bucket) give the offsets.

    Null texts have length 0. Null and repeated ids pass through, each row its own
    slot. Other columns are ignored. An empty table gives an empty result.
    """
    tokens = word_count(F.col(text_col)) if length is None else F.coalesce(length.cast("bigint"), F.lit(0))
    whole = docs.select(F.col(id_col).alias("id"), tokens.alias("whole")).withColumn("row", F.monotonically_increasing_id())
    last = F.greatest(F.ceil(F.col("whole") / batch_tokens) - 1, F.lit(0)).cast("int")
    slices = whole.withColumn("slice", F.explode(F.sequence(F.lit(0), last)))
    own = F.least(F.lit(batch_tokens).cast("bigint"), F.col("whole") - F.col("slice").cast("bigint") * batch_tokens)
    rows = cut(slices.select("id", "row", "slice", own.alias("n_tokens")))
    counted = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
    bounds = optimal_bounds({r["n_tokens"]: r["n"] for r in counted}, buckets)
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds]).cast(T.ArrayType(T.LongType()))
    placed = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))).withColumn(
        "bucket_len", F.coalesce(F.try_element_at(limits, F.col("bucket") + 1), F.col("n_tokens"))
    )
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row", "slice"), F.lit(chunks)))
    sizes = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "chunk", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("row", "slice")) - 1
    number = F.col("offset") + F.col("inside")
    capacity = F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_len"), F.lit(1))).cast("bigint")
    numbered = placed.withColumn("inside", inside).join(F.broadcast(offsets), ["bucket", "chunk"])
    return numbered.select(
        F.col("id").alias(id_col),
        "slice",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(number / capacity).alias("batch"),
        F.pmod(number, capacity).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
