"""Byte-level BPE with a minimal acyclic transducer as its lexicon of frequent words."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import os
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.arrow import over_texts
from strata.session import cut, placed

# How byte-level BPE cuts a text into words, and the same over ASCII alone.
WORDS = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_WORDS = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def word_splitter() -> Callable[[str], list[str]]:
    """A function that cuts a text into words; texts all ASCII take the faster engine."""
    import regex

    every, plain = regex.compile(WORDS).findall, re.compile(ASCII_WORDS).findall
    return lambda text: plain(text) if text.isascii() else every(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints in Latin-1, else the next from U+0100."""
    spare = iter(range(256, 512))
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and ids of one byte-level BPE file, as bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        octet = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        raw = {t: b"".join(octet[c] for c in t) for t in data["model"]["vocab"]}
        self.ids: dict[bytes, int] = {raw[t]: i for t, i in data["model"]["vocab"].items()}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.letters: list[int] = [self.ids[bytes([b])] for b in range(256)]
        self.ranks: dict[int, int] = {}  # of left id << 20 | right id
        self.made: list[int] = []  # the id that each rank's merge makes
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = (raw[t] for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks[self.ids[left] << 20 | self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        self.octets: dict[int, bytes] = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}

    def merge(self, word: bytes, short: int = 256) -> list[int]:
        """The exact ids of one word: lowest rank first, leftmost among equals.

        Words of at most ``short`` bytes look for the least rank in a list; longer
        ones keep their pairs in a heap, so that time stays near the length.
        """
        if len(word) > short:
            return self._merge_long(word)
        get, never = self.ranks.get, len(self.made)
        ids = [self.letters[b] for b in word]
        ranks = [get(a << 20 | b, never) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < never:
            at = ranks.index(rank)
            ids[at : at + 2] = (self.made[rank],)
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | ids[at], never)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 20 | ids[at + 1], never)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        get = self.ranks.get
        ids = [self.letters[b] for b in word]
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))
        heap = [(r, i, i + 1) for i in range(len(ids) - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or get(ids[i] << 20 | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, h, i))
        return [i for i in ids if i >= 0]


class Transducer:
    """A minimal acyclic automaton over words; its outputs are lists of ids.

    Equal suffixes share their states. Edges carry how many words sort before
    those below them, so the sum along a path is the word's place in the list, and
    the ids stand at that place. ``build`` writes one flat file; an instance maps
    it into memory and reads only what lookups touch.
    """

    MAGIC = b"STRATA01"

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self._map[:8] != self.MAGIC:
            raise ValueError("not a transducer file")
        states, edges, words, ids = np.frombuffer(self._map, dtype="<u4", count=4, offset=8).tolist()
        at = 24
        parts = []
        for kind, n in (("<u4", states + 1), ("<u4", edges), ("<u4", edges), ("<u4", words + 1), ("<u4", ids), ("u1", states)):
            parts.append(memoryview(self._map)[at : at + np.dtype(kind).itemsize * n].cast("I" if kind == "<u4" else "B"))
            at += np.dtype(kind).itemsize * n
        self._first, self._target, self._skip, self._start, self._ids, self._final = parts
        self._labels = at
        self._letters = [bytes([b]) for b in range(256)]

    def lookup(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None if the lexicon lacks it."""
        first, target, skip, find, letters = self._first, self._target, self._skip, self._map.find, self._letters
        base = self._labels
        state = place = 0
        for b in word:
            edge = find(letters[b], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            place += skip[edge]
            state = target[edge]
        if not self._final[state]:
            return None
        return self._ids[self._start[place] : self._start[place + 1]].tolist()

    @classmethod
    def build(cls, lexicon: dict[bytes, list[int]], path: str) -> None:
        """Write the file of :meth:`compile` at a local path."""
        with open(path, "wb") as file:
            file.write(cls.compile(lexicon))

    @classmethod
    def compile(cls, lexicon: dict[bytes, list[int]]) -> bytes:
        """The bytes of the minimal automaton of ``lexicon`` (words added in order, suffixes shared as soon as they are complete)."""
        words = sorted(lexicon)
        register: dict[tuple, int] = {}
        done: list[tuple] = []  # (final, ((label, state), ...)) of each shared state

        def share(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        path_nodes: list[list] = [[False, []]]  # final, finished edges
        labels: list[int] = []

        def fold(depth: int) -> None:
            while len(path_nodes) > depth + 1:
                node = path_nodes.pop()
                path_nodes[-1][1].append((labels.pop(), share(node)))

        last = b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            fold(common)
            for b in word[common:]:
                labels.append(b)
                path_nodes.append([False, []])
            path_nodes[-1][0] = True
            last = word
        fold(0)
        root = share(path_nodes[0])
        order = [root, *(s for s in range(len(done)) if s != root)]
        number = {s: i for i, s in enumerate(order)}
        below = [0] * len(done)
        for s, (final, out) in enumerate(done):  # targets come before sources
            below[s] = final + sum(below[t] for _, t in out)
        first, target, skip, final_flags, label_bytes = [0], [], [], [], bytearray()
        for s in order:
            final, out = done[s]
            passed = int(final)
            for label, t in out:
                label_bytes.append(label)
                target.append(number[t])
                skip.append(passed)
                passed += below[t]
            first.append(len(target))
            final_flags.append(final)
        ids = [i for w in words for i in lexicon[w]]
        starts = np.cumsum([0, *(len(lexicon[w]) for w in words)])
        numbers = ([len(done), len(target), len(words), len(ids)], first, target, skip, starts, ids)
        return b"".join([cls.MAGIC, *[np.asarray(n, dtype="<u4").tobytes() for n in numbers], bytes(final_flags), bytes(label_bytes)])


def word_counts(docs: DataFrame, text_col: str, flush: int = 500_000) -> DataFrame:
    """``(word, n)`` over all texts; each task adds up what it sees before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_splitter()
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words(text or ""))
            if len(seen) > flush:
                yield out()
        yield out()

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = 262_144, longest: int = 64) -> list[str]:
    """All words of at most ``longest`` letters seen at least 2**(b / 4) times, for the least b that gives at most ``most``."""
    counts = cut(counts.where(F.length("word") <= longest).select("word", F.floor(F.log2("n") * 4).cast("int").alias("b")))
    sizes = {r["b"]: r["n"] for r in counts.groupBy("b").agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    if least is None:
        return []
    return [r["word"] for r in counts.where(F.col("b") >= least).select("word").collect()]


class _Memo(dict):
    """Decimal ids by word, and in ``decoded`` the bytes that these ids stand for; a missing word is encoded."""

    def __init__(self, encode, octets: dict[int, bytes]):
        super().__init__()
        self.decoded: dict[str, bytes] = {}
        self._encode, self._octets = encode, octets
        self._digits = {i: str(i) for i in octets}

    def __missing__(self, word: str) -> str:
        ids = self._encode(word.encode())
        self.decoded[word] = b"".join([self._octets[i] for i in ids])
        self[word] = made = ",".join([self._digits[i] for i in ids])
        return made

    def forget(self) -> None:
        self.clear()
        self.decoded.clear()


class Encoder:
    """Encodes texts: lexicon first, exact merges for words that it lacks.

    The words seen last are kept as decimal ids, and forgotten once there are more
    than ``limit``.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None, limit: int = 800_000):
        self.vocabulary, self.lexicon, self.limit = vocabulary, lexicon, limit
        self.words = word_splitter()
        names = sorted(vocabulary.added, key=lambda t: (-len(t), t))
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.memo = _Memo(self.word, vocabulary.octets)

    def word(self, raw: bytes) -> list[int]:
        found = self.lexicon.lookup(raw) if self.lexicon else None
        return self.vocabulary.merge(raw) if found is None else found

    def encode(self, text: str) -> tuple[str, bytes]:
        """Ids as decimal text joined by commas, and the bytes that they decode to."""
        decimal, decoded = [], []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                token = self.vocabulary.added[part]
                decimal.append(str(token))
                decoded.append(self.vocabulary.octets[token])
            elif part:
                words = self.words(part)
                if len(self.memo) > self.limit:
                    self.memo.forget()
                decimal.append(",".join(map(self.memo.__getitem__, words)))
                decoded.extend(map(self.memo.decoded.__getitem__, words))
        return ",".join(decimal), b"".join(decoded)


def _worker_encoder(name: str, make: Callable[[], Encoder]) -> Encoder:
    """The encoder of this Python worker, which Spark uses for several tasks: one at a time, by its transducer's name."""
    kept = sys.modules.setdefault("_strata_encoder", ModuleType("_strata_encoder")).__dict__
    if kept.get("name") != name:
        kept.update(name=name, encoder=make())
    return kept["encoder"]


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 262_144, ids: bool = False
) -> DataFrame:
    """Each row's id, ``n_tokens``, and digests of its ids and of what they decode to.

    Two passes over the texts: word counts over all of them choose at most
    ``lexicon_words`` frequent words; the driver compiles these into a transducer
    file in the shared folder, which Spark hands to each executor; then every text is encoded. With
    ``ids`` the ids follow as ``token_ids array<int>``.

    A null text counts as empty: 0 tokens and the digests of nothing. Null ids and
    repeated rows pass through; other columns are ignored, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    vocabulary = Vocabulary(vocabulary_path)
    frequent = frequent_words(word_counts(source, "text"), lexicon_words)
    place = placed(docs.sparkSession, Transducer.compile({w.encode(): vocabulary.merge(w.encode()) for w in frequent}), "transducer")
    name = os.path.basename(place)
    context.addFile(place)
    shared = context.broadcast(vocabulary)

    def start():
        encoder = _worker_encoder(name, lambda: Encoder(shared.value, Transducer(SparkFiles.get(name))))

        def work(texts: list[str]) -> list[list]:
            collecting = gc.isenabled()
            gc.disable()  # nothing here makes cycles, and the memo is long to walk
            try:
                rows = [encoder.encode(t) for t in texts]
            finally:
                if collecting:
                    gc.enable()
            made = [
                [d.count(",") + 1 if d else 0 for d, _ in rows],
                [hashlib.sha256(d.encode()).hexdigest() for d, _ in rows],
                [hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest() for _, b in rows],
            ]
            return [*made, pa.array([np.fromiter(map(int, d.split(",")) if d else (), dtype=np.int32) for d, _ in rows], pa.list_(pa.int32()))] if ids else made

        return work

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")
    return over_texts(source, ["id"], "text", schema, start).withColumnRenamed("id", id_col)
