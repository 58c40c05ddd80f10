"""Secret scans: named patterns, and windows of high Shannon entropy. Column expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of the runs AKIA[A-Z0-9]+ just those of 20 or more
HEX = r"[0-9a-f]{24,}"  # of the runs [0-9a-f]+ just those of 24 or more
KINDS = ("assign", "access", "hex", "entropy")
ALPHABETS = {"hex": "0123456789abcdef", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "single": "abcdefghijklmnopqrstuvwxyz0123456789"}
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i:example|sample|dummy|placeholder|changeme|redacted|x{6}|0{8}|0123456789|abcdefghij)",
)
_SCALE = 1 << 20
_CHUNK = 128


@dataclass(frozen=True)
class EntropyRules:
    """Bits per character a window must reach, by character class, and patterns whose matches are no secrets."""

    window: int = 20
    bits: dict[str, float] = field(default_factory=lambda: {"hex": 3.0, "mixed": 3.8, "lower": 3.5, "upper": 3.5})
    allowed: tuple[str, ...] = ALLOWED

    @property
    def candidate(self) -> str:
        return rf"[A-Za-z0-9+/_=-]{{{self.window},}}"

    @property
    def allow(self) -> str:
        return "|".join(self.allowed)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it appears there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of each of the whole numbers ``values`` and all before it, beginning with 0.

    Lists of ``_CHUNK`` are joined on their own, and then with those before them:
    a fold would copy all it has made at every step.
    """
    total = lambda part: F.aggregate(part, F.lit(0), join)
    upto = lambda part, i: total(F.slice(part, F.lit(1), i + 1))

    def lists(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / _CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(v, i * _CHUNK + 1, F.lit(_CHUNK)))
        return F.transform(parts, lambda p: F.struct(p.alias("part"), total(p).alias("sum")))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: p["sum"])
        before = F.transform(parts, lambda p, i: F.struct(p["part"].alias("part"), F.when(i > 0, total(F.slice(sums, F.lit(1), i))).otherwise(0).alias("sum")))
        return F.flatten(F.transform(before, lambda p: F.transform(p["part"], lambda _, j: join(p["sum"], upto(p["part"], j)))))

    return bound(bound(values, lists), joined)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<s, e, v, w>>``: the leftmost non-overlapping matches, as code points from 0, end exclusive.

    Each match is taken together with the gap before it, so that lengths give
    positions; the last gap ends with the text. ``v`` is the length of ``group``,
    ``w`` the match itself. Only texts in which the pattern occurs pay for more
    than one search.
    """
    stepping = F.lit(rf"(?s)(.*?)({pattern}|\z)")
    part = lambda g: F.regexp_extract_all(text, stepping, F.lit(g))

    def placed(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda x: F.length(x["gap"]) + F.length(x["w"])), lambda p, q: p + q)
        made = F.zip_with(
            steps,
            ends,
            lambda x, e: F.struct((e - F.length(x["w"])).alias("s"), e.alias("e"), F.length(x["v"]).alias("v"), x["w"].alias("w")),
        )
        return F.filter(made, lambda m: m["w"] != "")

    steps = F.arrays_zip(part(1).alias("gap"), part(2).alias("w"), part(group + 2).alias("v"))
    return F.when(text.rlike(pattern), bound(steps, placed)).otherwise(F.array().cast("array<struct<s:int,e:int,v:int,w:string>>"))


def covered(spans: Column) -> Column:
    """One digit per code point up to the last span's end: 0 outside, 1 where a run of spans that touch or overlap begins, 2 further inside.

    ``spans`` are sorted by their start.
    """

    def digits(reach: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0))
            fresh = F.when((i == 0) | (at < x["s"]), 1).otherwise(0)
            inside = F.greatest(x["e"] - F.greatest(x["s"], at) - fresh, F.lit(0))
            gap = F.repeat(F.lit("0"), F.greatest(x["s"] - at, F.lit(0)))
            return F.concat(gap, F.repeat(F.lit("1"), fresh), F.repeat(F.lit("2"), inside))

        return F.transform(spans, one)

    reach = running(F.transform(spans, lambda x: x["e"]), lambda p, q: F.greatest(p, q))
    return F.array_join(bound(reach, digits), "")


def replaced(text: Column, digits: Column, first: Column, other: Column) -> Column:
    """``text`` with what stands at a 1 of :func:`covered` replaced by ``first``, at a 2 by ``other``; null leaves it out."""
    each = F.zip_with(
        F.split(text, ""), F.split(digits, ""), lambda c, d: F.when(d == "1", first).when(d == "2", other).otherwise(c)
    )
    return F.array_join(each, "")


def least_weight(word: Column, alphabet: str, window: int) -> Column:
    """The least sum of ``c log2 c`` over the counts ``c`` of any window of ``word``, times 2**20.

    The entropy of a window of ``w`` characters is ``log2 w`` less that sum over
    ``w``. Counts follow the sliding window: each step adds one character, takes
    one away, and changes the sum by the four terms that differ. Terms are whole
    numbers, so nothing drifts.
    """
    table = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0).cast("bigint") for c in range(window + 2)])
    slots = F.transform(F.split(word, ""), lambda ch: F.call_function("instr", F.lit(alphabet), ch))
    none = F.lit(1 << 62).cast("bigint")
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        none.alias("least"),
        F.lit(0).alias("i"),
        slots.alias("slots"),
    )

    def step(state: Column, new: Column) -> Column:
        counts, i = state["counts"], state["i"]
        full = i >= window
        old = F.when(full, F.get(state["slots"], i - window)).otherwise(-1)
        have, had = F.get(counts, new), F.when(full, F.get(counts, old)).otherwise(1)
        same = new == old
        change = F.get(table, have + 1) - F.get(table, have) + F.get(table, had - 1) - F.get(table, had)
        total = state["sum"] + F.when(same, F.lit(0).cast("bigint")).otherwise(change)
        moved = F.transform(counts, lambda c, k: c + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
        return F.struct(
            moved.alias("counts"),
            total.alias("sum"),
            F.when(i + 1 >= window, F.least(state["least"], total)).otherwise(state["least"]).alias("least"),
            (i + 1).alias("i"),
            state["slots"].alias("slots"),
        )

    return F.aggregate(slots, start, step, lambda state: state["least"])


def limit(bits: float, window: int) -> int:
    """The greatest :func:`least_weight` of a window that holds ``bits`` per character."""
    return math.floor(window * (math.log2(window) - bits) * _SCALE)


def _dense_piece(word: Column, rules: EntropyRules, case: str) -> Column:
    """Whether a run of letters and digits in a string of one case holds a window of high entropy."""
    pieces = F.filter(F.split(F.lower(word), "[+/_=-]"), lambda p: (F.length(p) >= rules.window) & p.rlike("[0-9]") & p.rlike("[a-z]"))
    return F.exists(pieces, lambda p: least_weight(p, ALPHABETS["single"], rules.window) <= limit(rules.bits[case], rules.window))


def high_entropy(word: Column, rules: EntropyRules) -> Column:
    """Whether a candidate holds a window of high entropy for its character class.

    Hexadecimal strings with a letter and a digit are judged over 16 symbols;
    others must mix upper case, lower case and digits. Of strings in one case,
    pieces between symbols count that have a letter and a digit; the rest, words
    and plain numbers among them, are no secrets.
    """
    is_hex = word.rlike("^[0-9a-fA-F]+$") & word.rlike("[0-9]") & word.rlike("[a-fA-F]")
    is_mixed = word.rlike("[0-9]") & word.rlike("[a-z]") & word.rlike("[A-Z]")
    dense = F.when(
        is_hex, least_weight(F.lower(word), ALPHABETS["hex"], rules.window) <= limit(rules.bits["hex"], rules.window)
    ).when(is_mixed, least_weight(word, ALPHABETS["mixed"], rules.window) <= limit(rules.bits["mixed"], rules.window))
    for case, letters, others in (("lower", "[a-z]", "[A-Z]"), ("upper", "[A-Z]", "[a-z]")):
        dense = dense.when(word.rlike("[0-9]") & word.rlike(letters) & ~word.rlike(others), _dense_piece(word, rules, case))
    return F.coalesce(dense, F.lit(False))


def _blanked(text: Column, spans: Column) -> Column:
    return F.when(F.size(spans) > 0, replaced(text, covered(spans), F.lit(" "), F.lit(" "))).otherwise(text)


def _pieces(found: Column, rules: EntropyRules) -> Column:
    """``array<struct<s, e, w>>`` of a candidate: itself, or what the allow-list leaves of it, if long enough."""
    whole = F.array(F.struct(found["s"].alias("s"), found["e"].alias("e"), found["w"].alias("w")))
    rest = matches(_blanked(found["w"], matches(found["w"], rules.allow)), rules.candidate)
    moved = F.transform(rest, lambda p: F.struct((found["s"] + p["s"]).alias("s"), (found["s"] + p["e"]).alias("e"), p["w"].alias("w")))
    return F.when(found["w"].rlike(rules.allow), moved).otherwise(whole) if rules.allowed else whole


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, ``array<struct<s, k, e>>`` in order; ``k`` counts the kinds."""
    assigned = F.filter(matches(text, ASSIGN, 1), lambda x: x["v"] >= 6)
    return F.array_sort(F.concat(_spans(assigned, 0), _spans(matches(text, ACCESS), 1), _spans(matches(text, HEX), 2)))


def entropy_spans(text: Column, rules: EntropyRules) -> Column:
    """Spans of the dense strings of ``text``."""
    pieces = F.flatten(F.transform(matches(text, rules.candidate), lambda x: _pieces(x, rules)))
    return _spans(F.filter(pieces, lambda p: high_entropy(p["w"], rules)), 3)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EntropyRules | None = None) -> DataFrame:
    """One row per row of ``docs``: the id and the secrets of its whole text.

    Returns ``(id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans)``.
    Base spans are those of the three patterns: assignments of six or more value
    characters, access keys, long lower-case hexadecimal runs. What they leave of
    the text is searched for candidate strings of ``window`` or more characters.
    Allowed matches are cut out of a candidate; each piece left that is long
    enough is an ``entropy`` span if a sliding window of it is dense enough. Spans
    are code points, end exclusive, by start, then kind.

    A null text is an empty one. Null ids and repeated rows pass through; other
    columns are ignored, whatever their names. Time is near linear in a text's
    length and matches, however many. Nothing is shuffled.
    """
    rules = rules or EntropyRules()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = _found(source, rules)
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("bigint")
    return found.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("added").cast("bigint").alias("n_entropy"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def _found(source: DataFrame, rules: EntropyRules) -> DataFrame:
    """``source`` with ``base`` and ``added`` spans of its column ``text``."""
    named = source.withColumn("base", base_spans(F.col("text"))).withColumn("left_over", _blanked(F.col("text"), F.col("base")))
    return named.withColumn("added", entropy_spans(F.col("left_over"), rules)).drop("left_over")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: EntropyRules | None = None) -> DataFrame:
    """``docs`` with each span of :func:`scan_secrets` replaced by ``mark``; spans that touch or overlap share one.

    All rows and columns stay; texts without a secret, null ones included, are unchanged.
    """
    rules = rules or EntropyRules()
    columns = docs.columns
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)])
    own = f"_{columns.index(text_col)}"
    found = _found(source.withColumn("text", F.coalesce(F.col(own).cast("string"), F.lit(""))), rules)
    every = F.array_sort(F.concat("base", "added"))
    masked = replaced(F.col("text"), covered(every), F.lit(mark), F.lit(None).cast("string"))
    clean = F.when(F.size("base") + F.size("added") > 0, masked).otherwise(F.col(own))
    return found.withColumn(own, clean).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])
