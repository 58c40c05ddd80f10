"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.arrow import BATCH_ROWS
from strata.operators.graph import connected_components
from strata.session import cut, small

BITS = 64
_CHUNK = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit ``hashes`` have each bit set, the lowest first."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return counts


def fingerprint(text: bytes | str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text, as such or in UTF-8.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A bit is
    set if it is set in more than half of the XXH64 values of the shingles,
    repeats counted. Fewer words than ``width`` make one shingle; no word, or a
    null text, gives 0. Bytes that are no UTF-8 are hashed as they are.
    """
    import xxhash

    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total = len(words) - width + 1
    starts, ends = starts[:total], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)]
        counts += bit_counts(np.array(hashes, dtype=np.uint64))
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 4) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fp``, the fingerprint as a signed long.

    One pass over the texts inside the scan's tasks; texts are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter(
                (fingerprint(t.as_py(), width) for t in batch.column("_text")), dtype=np.uint64, count=batch.num_rows
            )
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values.view(np.int64))], names=[*keep, "fp"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    source = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{fields}, fp bigint")


def segments(parts: int) -> list[tuple[int, int]]:
    """``(lowest bit, width)`` of each of ``parts`` nearly equal segments."""
    base, extra = divmod(BITS, parts)
    out, low = [], 0
    for i in range(parts):
        size = base + (i < extra)
        out.append((low, size))
        low += size
    return out


def radii(distance: int, parts: int) -> list[int]:
    """The ball radius searched in each segment; -1 leaves the segment out.

    With ``distance = a * parts + b``, two words at most ``distance`` apart differ
    by at most ``a`` bits in one of the first ``b + 1`` segments, or by at most
    ``a - 1`` in one of the others: else their distance were at least
    ``(b + 1)(a + 1) + (parts - b - 1) a = distance + 1``.
    """
    a, b = divmod(distance, parts)
    return [a if i <= b else a - 1 for i in range(parts)]


def ball(size: int, radius: int) -> list[int]:
    """All masks over ``size`` bits with at most ``radius`` set."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(size), r)]


def best_parts(distance: int, values: int) -> int:
    """The number of segments with the least work for each of ``values`` fingerprints: its probes, and what they meet by chance."""

    def work(parts: int) -> float:
        sizes = [size for _, size in segments(parts)]
        return sum(len(ball(size, r)) * (1 + values / 2**size) for size, r in zip(sizes, radii(distance, parts), strict=True))

    return min(range(2, max(3, distance + 1)), key=work)


def hamming_links(fingerprints: DataFrame, distance: int = 4, parts: int | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints at most ``distance`` bits apart.

    ``fingerprints`` has one column ``fp`` without repeats. Each value files itself
    once per segment under ``(segment, value)`` and probes every value in the ball
    around it; complete distances are verified inside the join, so that only links
    leave it. A pair that several segments find appears once. No candidate is
    capped: ``radii`` makes the search exact. :func:`best_parts` sets ``parts`` by
    the number of values: more and narrower segments for few, two for billions.
    """
    parts = parts or best_parts(distance, fingerprints.count())

    def key(value: Column, segment: int, low: int, size: int) -> Column:
        part = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << size) - 1))
        return part.bitwiseOR(F.lit(segment << 40).cast("bigint")) if size <= 40 else part

    filed, probes = [], []
    for i, ((low, size), radius) in enumerate(zip(segments(parts), radii(distance, parts), strict=True)):
        if radius < 0:
            continue
        own = key(F.col("fp"), i, low, size)
        filed.append(own)
        masks = F.array(*[F.lit(m).cast("bigint") for m in ball(size, radius)])
        probes.append(F.transform(masks, own.bitwiseXOR))
    entries = fingerprints.select(F.col("fp").alias("b"), F.explode(F.array(*filed)).alias("slot"))
    asked = fingerprints.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("slot"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    found = asked.join(entries, (asked["slot"] == entries["slot"]) & near)
    return found.select("a", "b").distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    distance: int = 4,
    parts: int | None = None,
) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and near-duplicate component.

    Returns ``(id, fp, component_id, n_links, component_fp)``: one row per input
    row, ``fp`` a signed long, ``component_id`` the smallest id in the component,
    ``n_links`` the number of other distinct fingerprints within ``distance``,
    ``component_fp`` the component's smallest fingerprint.

    Rows with equal fingerprints are one vertex, so copies are never paired.
    Null ids take part but are never the smallest; a component of nulls alone has
    a null ``component_id``. Null and blank texts have fingerprint 0 and are
    linked like others. Repeated rows stay repeated. Columns other than the two
    named are ignored. An empty table gives an empty result.
    """
    marks = cut(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", width))
    vertices = cut(marks.groupBy("fp").agg(F.min("id").alias("least_id")))
    links = cut(hamming_links(vertices.select("fp"), distance, parts))
    labels = connected_components(links).select(F.col("node").alias("fp"), "component")
    ends = links.select(F.col("a").alias("fp")).unionAll(links.select(F.col("b").alias("fp")))
    degree = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    rooted = cut(
        vertices.join(labels, "fp", "left")
        .join(degree, "fp", "left")
        .select("fp", "least_id", F.coalesce("component", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    classes = with_least_id(rooted)
    return marks.join(classes, "fp").select("id", "fp", "component_id", "n_links", "component_fp")


def with_least_id(rooted: DataFrame) -> DataFrame:
    """``rooted``, with a ``root`` and a ``least_id`` per vertex, with the root's least id as ``component_id``, the root as ``component_fp``.

    Roots of one vertex have their own id, and the others' are summed up before
    they meet the vertices, so that a root of a third of all vertices can be split.
    """
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("vertices"))
    least = cut(least.where("vertices > 1").select("root", F.struct("component_id").alias("c")))
    met = rooted.join(small(least), "root", "left")
    mine = F.when(F.col("c").isNull(), F.col("least_id")).otherwise(F.col("c.component_id"))
    return met.withColumn("component_id", mine).withColumnRenamed("root", "component_fp").drop("c", "least_id")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate component.

    The row with the smallest id stays (null only if all are null); of several
    rows of the component that share it, one with the smallest fingerprint. All
    columns are returned, extra ones whatever their names.
    """
    groups = cut(simhash_groups(docs, id_col, text_col, **options))
    width = options.get("width", 4)
    return keep_one(docs, groups, lambda df, keep, text: with_fingerprints(df, keep, text, width), id_col, text_col)


def keep_one(
    docs: DataFrame, groups: DataFrame, mark: Callable[[DataFrame, list[str], str], DataFrame], id_col: str, text_col: str
) -> DataFrame:
    """``docs`` with one row of each component of ``groups``: ``(id, fp, component_id, component_fp)`` per row.

    ``mark`` gives the kept columns and ``fp`` of rows whose id others share.
    """
    rows_per_id = groups.groupBy(F.col("id").alias("own_id")).agg(F.count("*").alias("rows"))
    gone = groups.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("gone_id")).distinct()
    repeated = cut(rows_per_id.where("rows > 1").select(F.col("own_id").alias("repeated_id")))
    gone = cut(gone.join(repeated, F.col("gone_id").eqNullSafe(F.col("repeated_id")), "left_anti"))
    names = [f"_{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    own = docs.toDF(*names)
    once = own.join(small(gone), F.col(key).eqNullSafe(F.col("gone_id")), "left_anti")
    if not repeated.isEmpty():
        once = once.join(small(repeated), F.col(key).eqNullSafe(F.col("repeated_id")), "left_anti")
        keepers = (
            groups.where(F.col("id").eqNullSafe(F.col("component_id")))
            .groupBy("component_fp", F.col("id").alias("keep_id"))
            .agg(F.min("fp").alias("keep_fp"))
        )
        shared = cut(keepers.join(repeated, F.col("keep_id").eqNullSafe(F.col("repeated_id"))).select("keep_id", "keep_fp"))
        ids = small(shared.select("keep_id").distinct())
        marked = mark(own.join(ids, F.col(key).eqNullSafe(F.col("keep_id"))).select(*names), names, text)
        kept = marked.join(shared, F.col(key).eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp")))
        once = once.unionByName(kept.dropDuplicates([key, "fp"]).select(*names))
    return once.toDF(*docs.columns)
