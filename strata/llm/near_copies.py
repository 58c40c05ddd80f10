"""Near copies by wide SimHash fingerprints, multi-index hashing and the exact Jaccard similarity of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.arrow import BATCH_ROWS
from strata.llm.simhash import bit_counts, keep_one, with_least_id
from strata.operators.graph import connected_components
from strata.session import cut, small, stored

_STEP = 0x9E3779B97F4A7C15  # odd, so that every word of a fingerprint mixes the shingles anew
_WEAK = 4  # bits of a segment that its ball flips
_SKETCH_BITS = 1024
_SIZE = 24  # bits that a set's size takes beside its vertex, in slots alone
_CROWD = 8  # vertices that make a slot crowded, for the first pass
_MEMBERS = 64  # larger components of the first pass don't meet themselves in the second


def shingle_set(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's shingles; words as in :func:`strata.llm.simhash.fingerprint`.

    Fewer words than ``width`` make one shingle, no word or a null text none.
    """
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, dtype=np.uint64))


def set_key(shingles: np.ndarray) -> int:
    """A signed long that stands for the whole set; 0 for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 1)).view(np.int64)) if len(shingles) else 0


def differing(percent: int) -> float:
    """The chance that a bit differs between two sets at exactly the similarity: the angle of their indicator vectors over pi."""
    return math.acos(2 * percent / (100 + percent)) / math.pi


def meeting(size: int, percent: int, samples: int = 20_000) -> float:
    """The chance that two sets at exactly the similarity meet in one segment, by simulation with a fixed seed.

    A bit is the sign of a sum over the set, normal with the cosine as correlation.
    Two segments meet if they are equal, or after each side has flipped at most one
    of its ``_WEAK`` bits with the sums nearest to zero.
    """
    rng, cosine = np.random.default_rng(7), 2 * percent / (100 + percent)
    one = rng.standard_normal((samples, size))
    two = cosine * one + math.sqrt(1 - cosine**2) * rng.standard_normal((samples, size))
    flips = (one > 0) != (two > 0)
    weak = []
    for sums in (one, two):
        mask = np.zeros_like(flips)
        np.put_along_axis(mask, np.argsort(np.abs(sums), axis=1)[:, :_WEAK], True, 1)
        weak.append(flips & mask)
    count, (mine, yours) = flips.sum(1), weak
    either = (mine | yours).sum(1)
    met = (count == 0) | (count == 1) & (either == 1) | (count == 2) & (either == 2) & mine.any(1) & yours.any(1)
    return float(met.mean())


def layout(rows: int, percent: int, recall: float) -> tuple[int, int, int]:
    """``(segments, bits of each, most differing bits of a fingerprint)`` for so many rows.

    A segment has two bits more than the rows need, so that chance meetings stay
    a few per row and segment at any size. There are as many segments as a pair
    just at the similarity needs to meet in one of them with probability
    ``recall``; the whole fingerprint may differ by three standard deviations more
    than such a pair's does on average.
    """
    size = min(32, max(16, math.ceil(math.log2(max(2, rows))) + 2))
    chance = differing(percent)
    count = math.ceil(math.log(1 - recall) / math.log(1 - meeting(size, percent)))
    bits = 64 * -(-count // 2)
    return count, size, math.ceil(bits * chance + 3 * math.sqrt(bits * chance * (1 - chance)))


def wide_fingerprint(shingles: np.ndarray, segments: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit SimHash words, each over another mix of the shingles' hashes, and the slots of their segments' balls.

    Two segments to a word: the lower ``size`` bits of each half. A ball is the
    segment's value, then what flipping one of its weak bits gives: the one whose
    count is nearest to a half, then the next. The segment's number stands above.
    """
    words = -(-segments // 2)
    bits, slots = np.zeros(words, dtype=np.int64), np.zeros((2 * words, 1 + _WEAK), dtype=np.int64)
    for k in range(words):
        mixed = shingles + np.uint64(_STEP * (k + 1) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        mixed ^= mixed >> np.uint64(33)
        lead = bit_counts(mixed) * 2 - len(shingles)
        octets = np.packbits(lead > 0, bitorder="little")
        bits[k] = octets.view(np.int64)[0]
        weak = np.argsort(np.abs(lead).reshape(2, 32)[:, :size], axis=1, kind="stable")[:, :_WEAK]
        own = octets.view(np.uint32).astype(np.int64) & ((1 << size) - 1)
        slots[2 * k : 2 * k + 2] = own[:, None]
        slots[2 * k : 2 * k + 2, 1:] ^= 1 << weak
    slots |= np.arange(2 * words)[:, None] << 40
    return bits, slots[:segments].ravel()


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their top bits: sets differ by no fewer elements than their sketches by bits."""
    parity = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=_SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *[p.view(np.int64) for p in parts]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))


def _mapped(source: DataFrame, width: int, schema: str, columns) -> DataFrame:
    """``source`` without its last column, a text as bytes, and with what ``columns`` makes of the texts' shingle sets."""
    keep = source.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(len(keep))]
            made = columns(sets)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *made.values()], names=[*keep, *made])

    source.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return source.mapInArrow(run, f"{fields}, {schema}" if keep else schema)


def with_set_keys(docs: DataFrame, keep: list[str], text_col: str, width: int) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fp``, the key of the text's shingle set."""
    source = docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_text"))
    return _mapped(source, width, "fp bigint", lambda sets: {"fp": pa.array([set_key(s) for s in sets], pa.int64())})


def _filed(vertices: DataFrame, words: int) -> DataFrame:
    """``(v, slot, one, two)``: a row for each slot of the balls around a vertex's segments, with two words that other segments make up.

    Each vertex files itself under its segment's value and those one weak bit away,
    and probes with the same, so that pairs two bits apart meet in the middle.
    ``v`` is the vertex with the size of its set in the lower ``_SIZE`` bits.
    """
    most = (1 << _SIZE) - 1
    v = F.shiftleft("v", _SIZE).bitwiseOR(F.least("n", F.lit(most).cast("bigint"))).alias("v")
    each = vertices.select(v, "bits", F.posexplode("slots").alias("at", "slot"))
    beside = lambda k: F.get("bits", F.expr(f"(at div {2 * (1 + _WEAK)} + {k}) % {words}").cast("int"))
    return each.select("v", "slot", beside(1).alias("one"), beside(2).alias("two"))


def _vertex(name: str) -> Column:
    return F.shiftright(F.col(name), _SIZE)


def _close(x: str, y: str, percent: int) -> Column:
    """Whether sizes and two words leave the similarity possible: as the complete distance does, where vertices meet."""
    size = lambda side: F.col(f"{side}.v").bitwiseAND(F.lit((1 << _SIZE) - 1).cast("bigint"))
    differ = lambda c: F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    chance = differing(percent)
    most = math.ceil(128 * chance + 3.5 * math.sqrt(128 * chance * (1 - chance)))
    return (100 * F.least(size(x), size(y)) >= percent * F.greatest(size(x), size(y))) & (differ("one") + differ("two") <= most)


def _bits_apart(one: str, two: str, words: int) -> Column:
    differ = [F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(two, F.lit(k)))) for k in range(words)]
    return sum(differ[1:], differ[0])


def _alike(words: int, distance: int, percent: int) -> Column:
    """Whether complete distance, sizes and sketches of ``x`` and ``y`` leave the similarity possible."""
    both = F.col("x.n") + F.col("y.n")
    sized = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    near = _bits_apart("x.bits", "y.bits", words) <= distance
    overlap = (100 + percent) * (both - _bits_apart("x.sketch", "y.sketch", _SKETCH_BITS // 64)) >= 2 * percent * both
    return sized & near & overlap


def _possible(pairs: DataFrame, marks: DataFrame, roots: DataFrame | None, alike: Column) -> DataFrame:
    """Pairs that may be similar and that no link has joined yet."""
    rooted = _with_root(marks, roots)
    x, y = rooted.alias("x"), rooted.alias("y")
    met = pairs.join(x, F.col("a") == F.col("x.v")).join(y, (F.col("b") == F.col("y.v")) & (F.col("x.root") != F.col("y.root")) & alike)
    return cut(met.select("a", "b"))


def _similar(possible: DataFrame, vertices: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``(a, b)``, numbers of sets, whose Jaccard similarity is ``percent`` hundredths or more: whole sets are compared."""
    asked = possible.select(F.col("a").alias("v")).unionAll(possible.select(F.col("b").alias("v"))).distinct()
    wanted = cut(asked.join(vertices, "v").select("v", F.col("h").alias("wanted")))
    found = texts.join(small(wanted), F.col("h") == F.col("wanted")).select("v", "text")
    sets = _mapped(found, width, "s array<bigint>", lambda sets: {"s": _lists(sets)}).dropDuplicates(["v"])
    sets = cut(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, two in zip(batch.column("s"), batch.column("t"), strict=True):
                one, two = (v.values.to_numpy() for v in (one, two))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                near.append((100 + percent) * shared >= percent * (len(one) + len(two)))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    ones = possible.join(sets.select(F.col("v").alias("a"), "s"), "a")
    both = ones.join(sets.select(F.col("v").alias("b"), F.col("s").alias("t")), "b").select("a", "b", "s", "t")
    return cut(both.mapInArrow(run, "a bigint, b bigint"))


def _roots(links: DataFrame) -> DataFrame:
    """``(v, root)`` of the vertices that have a link: ``root`` is the least of their component."""
    return cut(connected_components(links).select(F.col("node").alias("v"), F.col("component").alias("root")))


def _with_root(vertices: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return vertices.withColumn("root", F.col("v"))
    return vertices.join(small(roots), "v", "left").withColumn("root", F.coalesce("root", "v"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star_pairs(slots: DataFrame, percent: int) -> DataFrame:
    """In crowded slots, every vertex with the most central one: as many pairs as slots, however large a group is.

    What others were made from has most company in its slots, which is the score
    that makes a vertex the centre.
    """
    crowded = cut(slots.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= _CROWD))
    busy = stored(slots.join(small(crowded), "slot"), "crowded-slots")
    score = busy.groupBy("v").agg(F.sum("n").alias("score"))
    first = busy.join(score, "v").groupBy("slot").agg(F.max(F.struct("score", "v", "one", "two")).alias("first"))
    x, y = busy.alias("x"), first.select("slot", "first.v", "first.one", "first.two").alias("y")
    met = x.join(y, (F.col("x.slot") == F.col("y.slot")) & (F.col("x.v") != F.col("y.v")) & _close("x", "y", percent))
    return _ordered(met.select(_vertex("y.v").alias("a"), _vertex("x.v").alias("b")))


def _ball_pairs(slots: DataFrame, roots: DataFrame, marks: DataFrame, alike: Column, percent: int) -> DataFrame:
    """All pairs that meet in a slot, but for those inside one large component.

    Members of large components, which the first pass has joined already, meet
    small ones, and one another only in slots that two such components share.
    There whole fingerprints and sketches are compared at once, as a member that is
    none quite may meet all of the group.
    """
    sizes = roots.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > _MEMBERS)
    large = stored(roots.join(sizes.select("root"), "root", "left_semi").select(F.col("v").alias("member"), "root"), "large")
    same = F.col("x.slot") == F.col("y.slot")
    rest = slots.join(small(large.select("member")), _vertex("v") == F.col("member"), "left_anti")
    x, y = rest.alias("x"), rest.alias("y")
    pairs = x.join(y, same & (F.col("x.v") < F.col("y.v")) & _close("x", "y", percent)).select(_vertex("x.v").alias("a"), _vertex("y.v").alias("b"))
    if not large.isEmpty():
        own = slots.join(small(large), _vertex("v") == F.col("member")).select(F.col("member").alias("v"), "root", "slot")
        wide = stored(own.join(marks, "v"), "large-slots")
        met = rest.join(small(cut(wide.select("slot").distinct())), "slot", "left_semi").select(_vertex("v").alias("v"), "slot")
        beside = stored(met.join(marks, "v"), "slots-beside")
        two = [F.col("x.v").alias("a"), F.col("y.v").alias("b")]
        pairs = pairs.unionAll(beside.alias("x").join(wide.alias("y"), same & alike).select(*two))
        shared = wide.groupBy("slot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("slot")
        crowd = stored(wide.join(shared, "slot"), "crowd")
        pairs = pairs.unionAll(crowd.alias("x").join(crowd.alias("y"), same & (F.col("x.root") < F.col("y.root")) & alike).select(*two))
    return _ordered(pairs)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows``, cut, with a number ``v`` from 0 without gaps: short keys, that a shuffle packs well."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    counted = rows.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a number for each partition
    offsets, before = [0] * (1 + max((r["part"] for r in counted), default=0)), 0
    for r in sorted(counted, key=lambda r: r["part"]):
        offsets[r["part"]], before = before, before + r["n"]
    known = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    inside = F.col("row").bitwiseAND(F.lit((1 << 33) - 1).cast("bigint"))
    return rows.withColumn("v", F.get(known, F.shiftright("row", 33).cast("int")) + inside).drop("row")


def near_copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, recall: float = 0.95
) -> DataFrame:
    """``(id, fp, component_id, component_fp)`` of every row of ``docs``; ``fp`` is the key of its shingle set.

    Components are those of the graph that links two texts if the Jaccard
    similarity of their sets of ``width``-word shingles is ``percent`` hundredths
    or more. Candidates come from multi-index hashing over SimHash fingerprints
    of these sets, as :func:`layout` sizes them: small Hamming balls within each
    segment, over the bits likeliest to differ, then the complete distance. What
    is left is compared on the whole sets, so that no dissimilar pair is ever
    linked. A pair just at the similarity is found with probability ``recall``,
    closer ones nearly always. Two passes: in the first the vertices of a crowded
    slot meet its centre, in the second all those that the first has not joined.

    ``component_id`` is the smallest id, null if all are; ``component_fp`` numbers
    the component. Equal sets are one vertex; texts without a word are equal, and
    null ones are such. Bytes that are no UTF-8 are compared as they are. Repeated
    rows stay repeated. Other columns are ignored. An empty table gives an empty
    result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text, F.length(text)).alias("h"), text.cast("binary").alias("text"))
    count, size, distance = layout(docs.count(), percent, recall)
    words = -(-count // 2)

    def measured(sets: list[np.ndarray]) -> dict[str, pa.Array]:
        bits, slots = zip(*[wide_fingerprint(s, count, size) for s in sets], strict=True) if sets else ([], [])
        return {
            "fp": pa.array([set_key(s) for s in sets], pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "bits": _lists(list(bits)),
            "slots": _lists(list(slots)),
            "sketch": _lists([_sketch(s) for s in sets]),
        }

    marks = cut(_mapped(own, width, "fp bigint, n bigint, bits array<bigint>, slots array<bigint>, sketch array<bigint>", measured))
    first = [F.first(c).alias(c) for c in ("n", "bits", "slots", "sketch")]
    whole = _numbered(marks.groupBy("fp").agg(F.min("id").alias("least_id"), F.min("h").alias("h"), *first))
    texts, slots = own.select("h", "text"), stored(_filed(whole.where("n > 0"), words), "slots")
    facts, alike = whole.select("v", "n", "bits", "sketch"), _alike(words, distance, percent)
    met = _possible(_star_pairs(slots, percent), facts, None, alike)
    links = _similar(met, whole, texts, width, percent)
    roots = _roots(links)
    met = _possible(_ball_pairs(slots, roots, facts, alike, percent), facts, roots, alike)
    roots = _roots(links.unionByName(_similar(met, whole, texts, width, percent)))
    classes = with_least_id(cut(_with_root(whole.select("v", "fp", "least_id"), roots).select("fp", "least_id", "root")))
    return marks.select("id", "fp").join(classes, "fp").select("id", "fp", "component_id", "component_fp")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, recall: float = 0.95
) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_copy_groups`, as :func:`strata.llm.simhash.keep_one` chooses."""
    groups = cut(near_copy_groups(docs, id_col, text_col, width, percent, recall))
    return keep_one(docs, groups, lambda df, keep, text: with_set_keys(df, keep, text, width), id_col, text_col)
