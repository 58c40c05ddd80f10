"""Exact top-k by inner product without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of the lists, in 32nds, after which bounds are compared.
DEPTHS = (4, 8, 16, 20, 24, 28, 32)
#: Of a block's rows, those that may stand when reading stops and scores are resolved.
FINALISTS = 1 / 8


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component; null if the vector or a component is null or not finite.

    Components of 2**54 or more raise an error: a long does not hold their scores.
    """
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    huge = F.exists(vector, lambda x: F.abs(x.cast("double")) >= float(1 << 54))
    return F.when(sound, F.when(huge, F.raise_error(F.lit("a component is too large for whole-number scores"))).otherwise(whole))


class SortedLists:
    """A block of vectors as one list of ``(value, row)`` for each dimension, in ascending order.

    What has been read of a row after each of the ``DEPTHS`` is kept as bits, eight
    dimensions to an octet, for reading from the top and from the bottom.
    """

    def __init__(self, vectors: np.ndarray):
        self.n, width = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.n)[:, None], axis=0)
        self.depths = [-(-self.n * d // DEPTHS[-1]) for d in DEPTHS]
        self.bottom = [np.packbits(rank < d, axis=1) for d in self.depths]
        self.top = [np.packbits(rank >= self.n - d, axis=1) for d in self.depths]
        self.width = width


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # 256 x 8


def _read_sums(read: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """For each row the sum of ``worth`` over the dimensions whose bits are set: a table of 256 sums for each octet."""
    padded = np.zeros(8 * read.shape[1], dtype=np.int64)
    padded[: len(worth)] = worth
    tables = padded.reshape(-1, 8) @ _BITS.T
    out = tables[0][read[:, 0]]
    for octet in range(1, read.shape[1]):
        out += tables[octet][read[:, octet]]
    return out


def no_random_access(lists: SortedLists, vectors: np.ndarray, query: np.ndarray, left_out: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One query's ``k`` best rows of a block: ``(rows, scores, entries read of each list)``; ``left_out`` rows take no part.

    Each dimension's list is read from the end where the products are large, a
    stretch at a time; what is read adds to its row's partial score. A row's score
    lies between the partial score with the lists' far ends for what is unread,
    and with the values read last. Reading stops once no row outside the ``k`` best
    lower bounds can qualify, unseen ones included, but for few finalists (``4 k``
    rows, or ``FINALISTS`` of the block): their scores are then resolved. All sums
    are whole numbers.
    """
    n, positive = lists.n, query > 0
    near_end = np.where(positive, lists.values[:, -1], lists.values[:, 0])
    far_end = np.where(positive, lists.values[:, 0], lists.values[:, -1])
    used = np.flatnonzero(query)
    bits = np.packbits(positive), np.packbits(query < 0)
    worst = query * far_end
    partial = np.zeros(n, dtype=np.int64)
    alive = np.ones(n, dtype=bool)
    alive[left_out] = False
    at = 0
    for step, depth in enumerate(lists.depths):
        if depth == at and depth < n:
            continue
        for d in used:
            stretch = slice(n - depth, n - at) if positive[d] else slice(at, depth)
            partial[lists.rows[d, stretch]] += query[d] * lists.values[d, stretch]
        at = depth
        frontier = query * np.where(positive, lists.values[:, n - depth], lists.values[:, depth - 1])
        read = lists.top[step] & bits[0] | lists.bottom[step] & bits[1]
        low = partial + (worst.sum() - _read_sums(read, worst))
        high = partial + (frontier.sum() - _read_sums(read, frontier))
        standing = np.flatnonzero(alive)
        bar = np.partition(low[standing], len(standing) - k)[len(standing) - k] if len(standing) > k else None
        if bar is not None:
            alive &= high >= bar  # an unseen row's upper bound is the threshold: the frontier's sum
            standing = np.flatnonzero(alive)
        if len(standing) <= max(4 * k, FINALISTS * n) or at == n:
            scores = vectors[standing] @ query
            ranked = np.lexsort((standing, -scores))
            if len(ranked) > k:  # rows that tie with the last are ordered by their ids later
                ranked = ranked[scores[ranked] >= scores[ranked[k - 1]]]
            return standing[ranked], scores[ranked], at
    return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), at


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy().astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return out


def _checked(queries: np.ndarray, vectors: np.ndarray) -> None:
    """Raise where a bound could leave the range of a long."""
    most = [int(m) for m in np.abs(vectors).max(axis=0)] if len(vectors) else []
    for query in np.abs(queries).max(axis=0)[None, :] if len(queries) else []:
        if sum(int(a) * b for a, b in zip(query, most, strict=True)) >= 1 << 61:
            raise OverflowError("scores of these vectors do not fit a long")


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 16_384,
    block_queries: int = 2_048,
    depth: bool = False,
) -> DataFrame:
    """Each query's ``k`` highest integer inner products among all vectors but its own.

    Returns ``(query_id, rank, id, score)``, and with ``depth`` how many entries of
    each list were read, over all blocks, as ``n_read``. Components are quantised
    to ``floor(256 x)`` and all sums are whole numbers; where a long could overflow,
    the query fails. Vectors and queries are dealt into blocks; each pair of blocks
    meets in one task, which sorts the block's lists once, runs the
    no-random-access aggregation for every query and gives its ``k`` best, and
    these are ranked. Ties go to the smaller id, and equal rows to one another.

    Vectors that are null or hold a null or non-finite component, and rows with a
    null id, take no part. Shorter vectors count as padded with zeros. Repeated
    candidates are candidates each, but for rows with the query's id. A repeated
    query id counts once, with its smallest vector. A query with fewer candidates
    has fewer rows, with none no row. Other columns are ignored.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col)).alias("v")).where("id is not null and v is not null")

    rows = usable(vectors).withColumn("row", F.monotonically_increasing_id())
    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_queries = rows.count(), asked.count()
    row_blocks, query_blocks = -(-n_rows // block_rows) or 1, -(-n_queries // block_queries) or 1
    left = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(row_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    right = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn(
        "rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(row_blocks - 1).cast("bigint")))
    )
    left, right = left.select("qb", "rb", "id", "v"), right.select("qb", "rb", "id", "v")

    def block(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("n_read", pa.int64())])
        if not mine.num_rows or not theirs.num_rows:
            return schema.empty_table()
        width = max(1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (mine, theirs)))
        ids, query_ids = mine.column("id").to_numpy(), theirs.column("id").to_numpy()
        wanted, values = _matrix(theirs.column("v"), width), _matrix(mine.column("v"), width)
        _checked(wanted, values)
        lists = SortedLists(values)
        by_id = np.argsort(ids, kind="stable")
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for q, query in zip(query_ids, wanted, strict=True):
            own = by_id[np.searchsorted(ids, q, "left", by_id) : np.searchsorted(ids, q, "right", by_id)]
            found, scores, read = no_random_access(lists, values, query, own, k)
            best = np.lexsort((ids[found], -scores))[:k]
            reads = np.zeros(len(best), dtype=np.int64)
            reads[:1] = read
            for part, piece in zip(parts, (np.full(len(best), q), ids[found][best], scores[best], reads), strict=True):
                part.append(piece)
        return pa.table([pa.array(np.concatenate(p), pa.int64()) for p in parts], schema=schema)

    best = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(block, "query_id bigint, id bigint, score bigint, n_read bigint")
    if depth:
        best = best.withColumn("n_read", F.sum("n_read").over(Window.partitionBy("query_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score", *(["n_read"] if depth else []))
