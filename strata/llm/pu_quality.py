"""Quality classifier from trusted positives and unlabelled text."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.arrow import over_texts

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32, 9, 10, 11, 12, 13),
    "stop": map(ord, ".?;:"),
    "comma": (44,),
    "shout": (33,),
    "symbol": map(ord, "#*$%&<>^~=_+@\\"),
    "bar": (124,),
    "bracket": map(ord, "()[]{}"),
    "quote": map(ord, "\"'`"),
    "slash": map(ord, "/-"),
    "control": [*range(9), *range(14, 32), 127],
    "wide": range(128, 256),
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members), _i] = 1.0
N_FEATURES = len(_CLASSES) + 11


def features(text: str) -> np.ndarray:
    """Shape statistics of one whole text; an empty text gives zeros.

    They say how a text is written (character classes, repetition, line shape),
    not what about, and so hold across languages.
    """
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    octets = text.encode("utf-8", "surrogatepass")
    words = octets.split()
    n, size = len(words), len(octets)
    k = len(_CLASSES)
    counts = np.bincount(np.frombuffer(octets, dtype=np.uint8), minlength=256)
    out[:k] = np.sqrt(counts @ _TABLE / size)
    out[k] = np.log1p(size) / 10
    if not n:
        return out
    distinct = len(set(words))
    capital = sum(map(bytes.istitle, words))
    lines = [x for x in octets.split(b"\n") if x.split()]
    out[k + 1 :] = (
        np.log1p(n) / 10,
        (size - counts[list(_CLASSES["space"])].sum()) / n / 10,
        distinct / n,
        np.log1p(n / distinct) / 5,
        np.sqrt(sum(map(eq, words, words[1:])) / n),
        capital / n,
        sum(map(bytes.isupper, words)) / n,
        len(lines) / (n + 1),
        sum(x.rstrip().endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines),
        len(set(lines)) / len(lines),
    )
    return out


@dataclass
class Network:
    """One hidden layer over standardised features; ``score`` is a probability."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    hidden: int = 24,
    steps: int = 2_000,
    rate: float = 0.01,
    decay: float = 1e-4,
    batch: int = 500,
    seed: int = 7,
) -> Network:
    """Minimise the non-negative unbiased risk with the logistic loss.

    The risk is ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``.
    Where the part in brackets turns negative, the step goes against it instead,
    so that the network can't drive the risk of unlabelled text below zero.
    """
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    net = Network(
        every.mean(0),
        every.std(0) + 1e-3,
        rng.normal(0, 1 / np.sqrt(every.shape[1]), (every.shape[1], hidden)),
        np.zeros(hidden),
        np.zeros(hidden),
        0.0,
    )
    clean = [np.clip((x - net.mean) / net.scale, -6, 6) for x in (positive, unlabelled)]
    batches = max(1, min(len(positive), len(unlabelled)) // batch)
    epochs = -(-steps // batches)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        parts = [np.array_split(rng.permutation(len(x)), batches) for x in clean]
        for own_p, own_u in zip(*parts, strict=True):
            x = np.concatenate([clean[0][own_p], clean[1][own_u]])
            n_p, n_u = len(own_p), len(own_u)
            h = np.tanh(x @ params[0] + params[1])
            g = h @ params[2] + params[3][0]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            loss_neg = np.logaddexp(0, g)
            risk_neg = loss_neg[n_p:].mean() - prior * loss_neg[:n_p].mean()
            to_neg = np.concatenate([np.full(n_p, -prior / n_p), np.full(n_u, 1 / n_u)]) * s
            if risk_neg >= 0:
                d = to_neg
                d[:n_p] += prior / n_p * (s[:n_p] - 1)
            else:
                d = -to_neg
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [x.T @ back + decay * params[0], back.sum(0), h.T @ d + decay * params[2], np.array([d.sum()])]
            step += 1
            now = rate * (1 - epoch / epochs)
            for p, g_, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.05) -> float:
    """The share of positives in unlabelled text, from the best bin of a held-out half.

    A network that tells positives from unlabelled text ranks the other half of
    both. Where a top bin holds only positives, the share of unlabelled rows in it
    over the share of positives is the class prior; the bin with the least upper
    confidence bound is taken.
    """
    half = fit(positive[::2], unlabelled[::2], 0.5, steps=600)
    p, u = np.sort(half.logit(positive[1::2])), np.sort(half.logit(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    share_p = 1 - np.searchsorted(p, p, "left") / len(p)
    share_u = 1 - np.searchsorted(u, p, "left") / len(u)
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    at = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[at] / share_p[at], 0.05, 0.98))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a row's label stays unseen: crc32 of its id as text divides by ``folds``. A null id is held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(folds)) == 0


def training_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most_positive: int, most_unlabelled: int
) -> tuple[np.ndarray, np.ndarray]:
    """Features of trusted positives and of unlabelled rows, outside the held-out fold.

    A row is a trusted positive if all its labels are 1; rows with another label
    serve as neither. Of each role, rows whose id hashes below a threshold are
    taken, so that about ``most_positive`` and ``most_unlabelled`` come at any
    size. An id that stands on many rows gives one of them, so that repeats can't
    fill the driver. Only 25 numbers a row leave the scan's tasks.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    marks = marks.groupBy("id").agg(F.min("y").alias("y"))
    roles = (
        docs.select(F.col(id_col).alias("id"))
        .where(F.col("id").isNotNull() & ~held_out(F.col("id")))
        .join(marks, "id", "left")
        .select("id", F.when(F.col("y").isNull(), 0).when(F.col("y") == 1, 1).alias("role"))
        .where("role is not null")
    )
    sizes = {r["role"]: r["n"] for r in roles.groupBy("role").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.zeros((0, N_FEATURES)), np.zeros((0, N_FEATURES))
    scale = 1 << 30
    cuts = {role: min(scale, int(scale * most / sizes[role])) for role, most in ((1, most_positive), (0, most_unlabelled))}
    place = F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(scale))
    sample = roles.where(place < F.when(F.col("role") == 1, cuts[1]).otherwise(cuts[0])).distinct()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def start():
        return lambda texts: [[features(t).tolist() for t in texts]]

    marked = over_texts(chosen, ["id", "role"], "text", "x array<double>", start)
    rows = marked.groupBy("id", "role").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    made = [np.array([r["x"] for r in rows if r["role"] == role]).reshape(-1, N_FEATURES) for role in (1, 0)]
    rng = np.random.default_rng(3)
    return tuple(x[rng.permutation(len(x))] for x in made)


def _trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: tuple[int, int]) -> Network | None:
    positive, unlabelled = training_sample(docs, labels, id_col, text_col, label_col, *most)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def _scored(docs: DataFrame, keep: list[str], text_col: str, net: Network | None) -> DataFrame:
    def start():
        def work(texts: list[str]) -> list[np.ndarray]:
            if net is None:
                return [np.full(len(texts), 0.5)]
            return [net.score(np.array([features(t) for t in texts]))]

        return work

    return over_texts(docs, keep, text_col, "score double", start)


def pu_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    most_positive: int = 8_000,
    most_unlabelled: int = 12_000,
) -> DataFrame:
    """Score every whole text: ``(id, held_out, score, predicted)``.

    The network is fitted on the driver on a bounded sample (about
    ``most_positive`` trusted positives and ``most_unlabelled`` unlabelled rows,
    25 numbers each), with the class prior estimated from the same sample. Scores
    come from text alone. ``predicted`` is 1 if the score is at least
    ``threshold``.

    Null texts score as empty ones. Null ids are held out and never trained on.
    Repeated rows are scored alike. Without positives or without unlabelled rows
    every score is 0.5. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    net = _trained(docs, labels, id_col, text_col, label_col, (most_positive, most_unlabelled))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return _scored(source, ["id"], "text", net).select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.3,
    most_positive: int = 8_000,
    most_unlabelled: int = 12_000,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`pu_quality` predicts as 1."""
    net = _trained(docs, labels, id_col, text_col, label_col, (most_positive, most_unlabelled))
    names = [f"_{i}" for i in range(len(docs.columns))]
    scored = _scored(docs.toDF(*names), names, names[docs.columns.index(text_col)], net)
    return scored.where(F.col("score") >= threshold).select(*names).toDF(*docs.columns)
