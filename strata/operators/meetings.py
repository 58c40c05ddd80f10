"""Overlaps of whole sets query by query: postings meet inside a task, and no pair is ever shuffled."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut, once

#: Postings that a task packs at once.
PACK = 1 << 19
#: Rows of a batch of results.
ROWS = 1 << 17
NEVER = np.iinfo(np.int32).max
#: Bits of the map of shared keys, as a power of two, and of a part of it.
BITS, PART = 26, 20


def _bytes(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())


def _whole(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def tidy(run: Callable) -> Callable:
    """``run`` over batches; then what its task held goes back to the system, as the worker stays for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return whole


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well mixed bits of each number."""
    z = x.astype(np.uint64) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _block(pos: np.ndarray, blocks: int) -> np.ndarray:
    return (_mixed(pos, 0x51) % np.uint64(blocks)).astype(np.int64)


def _packed(slots: int):
    """Postings as rows ``(slot, keys, pos, counts)``, one for each slot of some units: keys in the units' order."""

    def flush(keys: list[np.ndarray], units: list[int]) -> pa.RecordBatch:
        every, sizes = np.concatenate(keys), [len(k) for k in keys]
        unit = np.repeat(np.arange(len(units)), sizes)
        at = (every % np.uint64(slots)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=slots))
        made, pos = [], np.array(units, np.int64)
        for slot, (a, b) in enumerate(zip(ends - np.diff(ends, prepend=0), ends, strict=True)):
            who, counts = np.unique(unit[order[a:b]], return_counts=True)
            made.append((every[order[a:b]], pos[who], counts.astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), *(_bytes([m[i] for m in made]) for i in range(3))], names=["slot", "keys", "pos", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, units, held = [], [], 0
        for batch in batches:
            sets, salts, pos = batch.column(0), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_pylist()
            values, ends = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            for i, p in enumerate(pos):
                if ends[i] < ends[i + 1]:
                    keys.append(values[ends[i] : ends[i + 1]] ^ salts[i])
                    units.append(p)
                    held += len(keys[-1])
                if held >= PACK:
                    yield flush(keys, units)
                    keys, units, held = [], [], 0
        if held:
            yield flush(keys, units)

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a slot's postings, the lists of two units and more as rows ``(a, b, n, w, members, keys)``: ``w`` keys have the same ``n`` members."""
    parts = [(_whole(x.column(1), np.uint64), _whole(x.column(2), np.int64), _whole(x.column(3), np.uint32)) for x in batches]
    if not sum(len(p[0]) for p in parts):
        return
    keys = np.concatenate([p[0] for p in parts])
    pos = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
    del parts
    order = np.argsort(keys, kind="stable")
    keys, pos = keys[order], pos[order]
    same = keys[1:] == keys[:-1]
    twice = np.append(same, False) | np.insert(same, 0, False)
    keys, pos = keys[twice], pos[twice]
    order = np.lexsort((pos, keys))
    keys, pos = keys[order], pos[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (pos[1:] != pos[:-1])  # a unit on several rows counts once
    keys, pos = keys[new], pos[new]
    if not len(keys):
        return
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = (np.add.reduceat(_mixed(pos, salt), starts) for salt in (0xA1, 0xB2))
    wide = np.flatnonzero(sizes > 1)
    order = wide[np.lexsort((b[wide], a[wide], sizes[wide]))]
    if not len(order):
        return
    fresh = np.append(True, (sizes[order][1:] != sizes[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    first = order[fresh]
    weights = np.diff(np.append(np.flatnonzero(fresh), len(order)))
    named = np.split(keys[starts[order]], np.cumsum(weights)[:-1])
    for k in range(0, len(first), 4096):
        f = first[k : k + 4096]
        columns = [a[f].view(np.int64), b[f].view(np.int64), sizes[f].astype(np.int64), weights[k : k + 4096].astype(np.int64)]
        members = _bytes([np.diff(pos[s : s + n], prepend=0) for s, n in zip(starts[f], sizes[f], strict=True)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), members, _bytes(named[k : k + 4096])], names=["a", "b", "n", "w", "members", "keys"])


def _sent(blocks: int):
    """Each list, and the names of its keys if they are there, as a row for every block that one of its members is in."""

    def rows(to: list[int], w: list[int], members: list[bytes], keys: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(w, pa.int64()), pa.array(members, pa.binary()), pa.array(keys, pa.binary())], names=["block", "w", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = ([], [], [], []), 0
            for weight, data, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.unique(_block(np.cumsum(np.frombuffer(data, np.int64)), blocks))
                for part, x in zip(made, (own.tolist(), *([x] * len(own) for x in (weight, data, keys))), strict=True):
                    part += x
                held += len(data) * len(own)
                if held >= 16 * PACK:
                    yield rows(*made)
                    made, held = ([], [], [], []), 0
            if made[0]:
                yield rows(*made)

    return run


def _known(blocks: int):
    """Units ``(pos, rank, as query, as candidate)`` as rows for every block, with ``w`` 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy() for c in batch.columns[:2]], 1).tobytes()
                y = np.stack([c.to_numpy() for c in batch.columns[2:]], 1).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([0] * blocks, pa.int64()), pa.array([x] * blocks, pa.binary()), pa.array([y] * blocks, pa.binary())], names=["block", "w", "x", "y"])

    return run


def _slot(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 0xC3) >> np.uint64(64 - BITS)).astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of keys, as rows of a part of the map."""
    for batch in batches:
        at = np.unique(_slot(_whole(batch.column(0), np.uint64)))
        parts = np.unique(at >> PART)
        split = np.split((at & ((1 << PART) - 1)).astype(np.int32), np.searchsorted(at >> PART, parts[1:]))
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), _bytes(split) if len(parts) else pa.array([], pa.binary())], names=["part", "bits"])


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps = {}
    for batch in batches:
        for part, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            maps.setdefault(part, np.zeros(1 << PART, bool))[np.frombuffer(at, np.int32)] = True
    if maps:
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), _bytes([np.packbits(m) for m in maps.values()])], names=["part", "bits"])


def _shared(lists: DataFrame) -> np.ndarray:
    """A map of ``2**BITS`` bits, however many keys there are, in which those of all lists are set."""
    rows = lists.select("keys").mapInArrow(_slots, "part int, bits binary").repartitionById(1 << (BITS - PART - 2), F.col("part") % (1 << (BITS - PART - 2)))
    found = np.zeros(1 << (BITS - 3), np.uint8).reshape(-1, 1 << (PART - 3))
    for r in rows.mapInArrow(_mapped, "part int, bits binary").collect():
        found[r.part] = np.frombuffer(r.bits, np.uint8)
    return found.ravel()


def _walks(blocks: int, known: np.ndarray, run_of: int):
    """Streams ``(keys, salt, pos)`` of the queries as rows for their own block, with ``w`` -1: keys in ``x``, the unit in ``y``.

    Only streams with ``run_of`` positions in a row whose keys are on the map of ``known`` ones move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = batch.column(0).values.to_numpy().view(np.uint64), batch.column(0).offsets.to_numpy()
            salts, pos = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            streams, own = [], []
            for a, b, s, p in zip(ends[:-1], ends[1:], salts, pos, strict=True):
                keys = values[a:b] ^ s
                at = _slot(keys)
                gaps = np.flatnonzero((known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0)
                if np.diff(gaps, prepend=-1, append=len(keys)).max() > run_of:
                    streams.append(keys)
                    own.append(p)
            if own:
                w, own = pa.array(np.full(len(own), -1, np.int64)), np.array(own, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_block(own, blocks).astype(np.int32)), w, _bytes(streams), _bytes([*own.reshape(-1, 1)])], names=["block", "w", "x", "y"])

    return run


def _longest(has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each row's longest run of true values, the first among equals; length 0 if none is true."""
    rows, width = has.shape
    edges = np.diff(np.pad(has, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    length = np.nonzero(edges == -1)[1] - start
    best = np.zeros(rows, np.int64)
    np.maximum.at(best, row, length)
    at = np.full(rows, width, np.int64)
    top = length == best[row]
    np.minimum.at(at, row[top], start[top])
    return at, best


def _least(keys: np.ndarray, has: np.ndarray, run_of: int) -> int:
    """The fewest distinct keys of ``run_of`` positions in a row that are all held; there are some."""
    edges = np.concatenate(([-1], np.flatnonzero(~has), [len(has)]))
    wide, least = np.flatnonzero(np.diff(edges) > run_of), run_of
    for a, b in zip(edges[wide] + 1, edges[wide + 1], strict=True):
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(keys[a:b], run_of), axis=1)
        least = min(least, int((rows[:, 1:] != rows[:, :-1]).sum(1).min()) + 1)
    return least


def _walked(walks: list[tuple[int, bytes]], pos: np.ndarray, names: np.ndarray, listed: np.ndarray, firsts: np.ndarray, run_of: int) -> dict[int, tuple[int, list[np.ndarray]]]:
    """Of the queries whose stream has a run of positions that some earlier unit has each: the fewest distinct keys of such, and the list at each position or -1.

    ``names`` are all lists' keys in order, ``listed`` their lists and ``firsts`` the lists' first members.
    """
    kept = {}
    while walks and len(names):
        some, held = [], 0
        while walks and held < PACK:
            some.append(walks.pop())
            held += len(some[-1][1]) // 8
        keys = np.frombuffer(b"".join(x for _, x in some), np.uint64)
        sizes = np.array([len(x) // 8 for _, x in some])
        asking = np.searchsorted(pos, np.array([p for p, _ in some], np.int64))
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(names, keys[order]), len(names) - 1)
        lists = np.empty(len(keys), np.int32)
        lists[order] = np.where(names[at] == keys[order], listed[at], -1)
        lists[(lists >= 0) & (firsts[lists] >= np.repeat(asking, sizes))] = -1
        ends = np.cumsum(sizes)
        gaps = np.flatnonzero(np.insert(lists, ends, -1) < 0)  # one more after each stream
        wide = gaps[np.diff(gaps, prepend=-1) > run_of]
        for k in np.unique(np.searchsorted(ends + np.arange(len(ends)), wide)):
            own = slice(ends[k] - sizes[k], ends[k])
            least, before = kept.get(int(asking[k]), (run_of, []))
            kept[int(asking[k])] = min(least, _least(keys[own], lists[own] >= 0, run_of)), [*before, lists[own].copy()]
    return kept


def _met(blocks: int, budget: int | None, run_of: int | None = None):
    """A block's queries, one after the other: the overlaps of all their candidates, of which the best ``budget`` stay.

    With ``run_of``, the longest run of as many positions of the query's stream that
    the candidate has follows, and pairs without one go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, needs, weights, sizes, deltas, names, walks, block = [], [], [], [], [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, w = batch.column(0)[0].as_py(), batch.column(1).to_numpy()
            x, listed = batch.column(2), w > 0
            lists = x.filter(pa.array(listed)).to_pylist()
            sizes.append(np.array([len(m) // 8 for m in lists], np.int64))
            deltas.append(b"".join(lists))
            weights.append(w[listed])
            if run_of:
                names.append(_whole(batch.column(3).filter(pa.array(listed)), np.uint64))
                y = batch.column(3).filter(pa.array(w < 0)).to_pylist()
                walks += zip([int(np.frombuffer(p, np.int64)[0]) for p in y], x.filter(pa.array(w < 0)).to_pylist(), strict=True)
                listed |= w < 0
            units.append(_whole(x.filter(pa.array(~listed)), np.int64).reshape(-1, 2))
            needs.append(_whole(batch.column(3).filter(pa.array(~listed)), np.int32).reshape(-1, 2))
        if block is None:
            return
        units, needs = np.concatenate(units), np.concatenate(needs)
        order = np.argsort(units[:, 0])
        pos, rank, needs = units[order, 0], units[order, 1], needs[order]
        place = np.empty(len(pos), np.int64)
        place[np.argsort(rank)] = np.arange(len(pos))
        members = np.empty(sum(map(len, deltas)) // 8, np.int32)
        end = len(members)
        for own in reversed(sizes):
            sums = np.cumsum(np.frombuffer(deltas.pop(), np.int64))
            firsts = np.cumsum(own) - own
            base = np.insert(sums, 0, 0)[firsts]
            members[end - len(sums) : end] = np.searchsorted(pos, sums - np.repeat(base, own))
            end -= len(sums)
        sizes, weights = np.concatenate(sizes), np.concatenate(weights)
        starts = np.cumsum(sizes) - sizes
        del units
        asked = (_block(pos, blocks) == block) & (needs[:, 0] < NEVER)
        hits = np.flatnonzero(asked[members])
        hits = hits[np.argsort(members[hits], kind="stable")]
        lists = np.searchsorted(starts, hits, "right") - 1
        edges = np.append(np.flatnonzero(np.diff(members[hits], prepend=-1)), len(hits))
        total, made, held = np.zeros(len(pos), np.int64), [], 0
        if run_of:
            names, listed = np.concatenate(names), np.repeat(np.arange(len(sizes), dtype=np.int32), weights)
            order = np.argsort(names)
            names, listed = names[order], listed[order]
            kept = _walked(walks, pos, names, listed, members[starts] if len(members) else members, run_of)
            slot = np.full(len(pos), -1, np.int32)
            del names, listed
        for u, v in zip(edges[:-1], edges[1:], strict=True):
            q = members[hits[u]]
            if run_of and q not in kept:
                continue
            spans = [(members[starts[k] : h], weights[k]) for k, h in zip(lists[u:v], hits[u:v], strict=True) if h > starts[k]]
            later = []
            if run_of:  # a unit with fewer keys of the query has no run, nor a better place than one with a run
                least, own_walks = kept.pop(q)
                by_list = dict(zip(lists[u:v].tolist(), hits[u:v].tolist(), strict=True))
                spans.sort(key=lambda x: len(x[0]))
                spare = least - 1
                while spans[-1][1] <= spare:
                    spare -= spans[-1][1]
                    later.append(spans.pop())
            for span, w in spans:
                total[span] += w
            found, overlaps = [], []
            for span, _ in spans:  # each candidate is taken at its first list
                n = total[span]
                first = n > 0
                found.append(span[first])
                overlaps.append(n[first])
                total[span] = 0
            if not spans:
                continue
            c, n = np.concatenate(found), np.concatenate(overlaps)
            if run_of:
                stay = n + sum(w for _, w in later) >= least
                c, n = c[stay], n[stay]
                for span, w in later:  # lists that no candidate lives on alone
                    n[span[np.minimum(np.searchsorted(span, c), len(span) - 1)] == c] += w
                c, n = c[n >= least], n[n >= least]
            if budget is not None:
                score = n * len(pos) - place[c]
                if len(c) > budget:
                    best = np.argpartition(score, len(c) - budget)[len(c) - budget :]
                    c, n, score = c[best], n[best], score[best]
                order = np.argsort(-score)
                c, n = c[order], n[order]
            rn = np.arange(1, len(c) + 1, dtype=np.int32)
            stay = (n >= needs[q, 0]) & (n >= needs[c, 1])
            if not stay.all():
                c, n, rn = c[stay], n[stay], rn[stay]
            if run_of and len(c):
                begun, ran = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
                slot[c] = np.arange(len(c))
                for own in own_walks:
                    there, column = np.unique(own, return_inverse=True)
                    held_by = np.zeros((len(c), len(there)), bool)
                    for i, k in enumerate(there):
                        if k >= 0:  # else no earlier unit has the position
                            mine = slot[members[starts[k] : by_list[k]]]
                            held_by[mine[mine >= 0], i] = True
                    for a in range(0, len(c), 64):
                        start, length = _longest(held_by[a : a + 64][:, column])
                        more = length > ran[a : a + 64]
                        begun[a : a + 64][more], ran[a : a + 64][more] = start[more], length[more]
                slot[c] = -1
                stay = ran >= run_of
                c, n, begun, ran = c[stay], n[stay], begun[stay], ran[stay]
                made.append((np.full(len(c), pos[q]), pos[c], begun.astype(np.int32), ran))
            elif not run_of:
                made.append((np.full(len(c), pos[q]), pos[c], n, rn)[: 3 if budget is None else 4])
            held += len(c)
            if held >= ROWS:
                yield from batches_of(made)
                made, held = [], 0
        yield from batches_of(made)

    def batches_of(made: list[tuple]) -> Iterator[pa.RecordBatch]:
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=["q", "c", *(["start", "length"] if run_of else ["overlap", "rn"])][: len(made[0])])

    return run


def meetings(units: DataFrame, budget: int | None = None, asks: Column | None = None, gives: Column | None = None, run_of: int | None = None) -> DataFrame:
    """``(q, c, overlap)``, and ``rn`` with a budget: whole overlaps of ``shingles`` of units of one language, ``c < q``.

    With a ``budget``, each query's so many of greatest overlap, ties by path, line
    and name, stay, and ``rn`` is their place; without one, all do. After that
    only pairs stay whose overlap is at least ``asks`` of the query and ``gives`` of
    the candidate; a null lets no pair stay (of ``asks``: none is looked for).
    With ``run_of``, pairs stay whose query's ``shingle_seq`` has a run of at least as
    many positions that the candidate has: ``(q, c, start, length)`` of the longest,
    the earliest among equals.

    Each posting moves once, to be grouped by shingle. Most shingles are in one unit
    and end there; shingles with the same units become one list of a weight. Lists
    go to the blocks of their members, where each query adds up its own lists. So
    the time grows with the meetings, disk and memory with the postings alone.
    ``units`` may be a plan that computes its streams: they are read once.
    """
    context = units.sparkSession.sparkContext
    cores, tasks = context.defaultParallelism, units.rdd.getNumPartitions()
    slots = 4 * max(cores, tasks)
    known = units.where("pos is not null")
    sets = known.where("language is not null").select("shingles", F.xxhash64("language").alias("salt"), F.col("pos").cast("bigint").alias("pos"))
    packed = sets.mapInArrow(tidy(_packed(slots)), "slot int, keys binary, pos binary, counts binary")
    lists = packed.repartitionById(slots, "slot").mapInArrow(tidy(_lists), "a bigint, b bigint, n bigint, w bigint, members binary, keys binary")
    names = F.reduce(F.collect_list("keys"), F.lit(b""), lambda x, k: F.concat(x, k)) if run_of else F.lit(None).cast("binary")
    lists = once(lists.groupBy("a", "b", "n").agg(F.sum("w").alias("w"), F.first("members").alias("members"), names.alias("keys")))
    share = 2 * PACK if run_of else 16 * PACK  # streams and keys' names take memory too
    blocks = max((6 if run_of else 2) * cores, -(-(lists.agg(F.sum("n")).first()[0] or 0) // share))
    need = lambda c: F.coalesce(F.lit(1) if c is None else c, F.lit(int(NEVER))).cast("int")
    ranked = known.select(
        F.col("pos").cast("bigint").alias("pos"), "path", "start_line", "qualified_name", need(asks).alias("asks"), need(gives).alias("gives")
    ).orderBy(F.asc_nulls_last("path"), F.asc_nulls_last("start_line"), F.asc_nulls_last("qualified_name"), "pos")
    ranked = cut(ranked.select("pos", F.monotonically_increasing_id().alias("rank"), "asks", "gives"))
    ranked = ranked.groupBy("pos").agg(F.min("rank").alias("rank"), F.min("asks").alias("asks"), F.min("gives").alias("gives"))
    form = "block int, w bigint, x binary, y binary"
    sent = lists.select("w", "members", "keys").mapInArrow(_sent(blocks), form).unionAll(ranked.mapInArrow(_known(blocks), form))
    made = "q bigint, c bigint, overlap bigint" + (", rn int" if budget is not None else "")
    if run_of:
        walks = known.where("language is not null").where(need(asks) < int(NEVER))  # a filter on streams would compute them again for each window
        walks = walks.select("shingle_seq", F.xxhash64("language").alias("salt"), F.col("pos").cast("bigint").alias("pos"))
        sent, made = sent.unionAll(walks.mapInArrow(_walks(blocks, _shared(lists), run_of), form)), "q bigint, c bigint, start int, length bigint"
    return sent.repartitionById(blocks, "block").mapInArrow(tidy(_met(blocks, budget, run_of)), made)
