"""Column functions over texts and token streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"
UNIT_SEPARATOR = "\x1f"


def words(text: Column) -> Column:
    """Lower-case words of a text, split at ASCII white space; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def windows(tokens: Column, width: int = 5, separator: str = " ") -> Column:
    """Each run of ``width`` tokens as one text, in order; fewer tokens give none.

    ``tokens`` should be a column, not an expression: it is read once per window.
    """
    n = F.size(tokens) - (width - 1)
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, width), separator))


def hashed(parts: Column) -> Column:
    """64-bit hashes of texts, in order."""
    return F.transform(parts, lambda p: F.xxhash64(p))


def window_hashes(own: Column, width: int = 5) -> Column:
    """A 64-bit hash for each run of ``width`` tokens, in order; fewer tokens give none.

    ``own``, the tokens' own hashes, should be a column: it is read once per window.
    """
    starts = F.slice(own, F.lit(1), F.greatest(F.size(own) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(own, i + k) for k in range(1, width)]))


def unique_sorted(values: Column) -> Column:
    """Distinct values in order, of arrays without nulls."""
    return F.sort_array(F.array_distinct(values))


def stream_hash(tokens: Column) -> Column:
    """One digest for a whole token stream."""
    return F.sha2(F.array_join(tokens, UNIT_SEPARATOR), 256)


def normalized_leaf(token: Column) -> Column:
    """``LIT`` for tokens that start with a digit or a quote, ``ID`` for words, others as they are."""
    return F.when(token.rlike("^[0-9\"'`]"), "LIT").when(token.rlike("^[\\p{L}_]"), "ID").otherwise(token)


def shape_class(word: Column) -> Column:
    """A word's shape: length up to 9, then D with a digit in it, P with a mark in it."""
    return F.concat(
        F.least(F.length(word), F.lit(9)).cast("string"),
        F.when(word.rlike("[0-9]"), "D").otherwise(""),
        F.when(word.rlike(r"[^\p{L}0-9]"), "P").otherwise(""),
    )


def code_lines(text: Column) -> Column:
    """Number of lines with a visible character."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\r\f\x0B]")))


def sentence_ends(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), ".!?", ""))


def mass(cc: Column, sloc: Column) -> Column:
    """Complexity weighted by size."""
    return cc * F.sqrt(sloc)


def line_hashes(text: Column) -> Column:
    """A hash for each line; one trailing empty line doesn't count, an empty text has none."""
    lines = F.split(text, "\n")
    trimmed = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(hashed(trimmed))


def run_lengths(values: Column) -> Column:
    """Run-length pairs ``array<struct<n, value>>`` of an array column (not an expression: it is indexed)."""
    starts = F.array_compact(F.transform(values, lambda x, i: F.when((i == 0) | (x != F.get(values, i - 1)), i)))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(values)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct((b - a).alias("n"), F.get(values, a).alias("value")))
    return F.when(F.size(values) > 0, runs).otherwise(F.filter(runs, lambda r: F.lit(False)))


def from_run_lengths(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))


def hex_sequence(values: Column) -> Column:
    """32-bit numbers as one text, eight hexadecimal digits each."""
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def from_hex_sequence(text: Column) -> Column:
    n = (F.length(text) / 8).cast("int")
    starts = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def jaccard(overlap: Column, left: Column, right: Column) -> Column:
    """Jaccard similarity from counts; two empty sets give 0."""
    union = left + right - overlap
    return F.when(union > 0, overlap / union).otherwise(F.lit(0.0))


def relative_path(path: Column) -> Column:
    """Whether a path is relative and has no backslash, empty, ``.`` or ``..`` segment."""
    return ~path.contains("\\") & F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))


def locator(text: Column) -> Column:
    """A dependency source without surrounding blanks and trailing slashes."""
    return F.regexp_replace(F.trim(text), "/+$", "")
