"""Quality rules, line first: clean lines, then judge what is left of a document."""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.arrow import over_texts

# Fixed values.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|·•»›>/"
STOPS = ".!?…。:;\"'”’)»"
BOILERPLATE = (
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies"
    r"|enable javascript|subscribe to|sign up for|log ?in to|click here|read more|share (?:this|on)"
    r"|lorem ipsum"
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; fractions are of a line's words, ``max_loss`` of a document's word characters."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_words: float = 0.3
    max_shout_words: float = 0.3
    max_stutter_words: float = 0.3
    max_separators: float = 0.2
    min_separators: int = 3
    max_unstopped_words: int = 4
    max_boilerplate_words: int = 25
    max_loss: float = 0.5


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words found twice or more.

    Windows are compared by exact ranks of pairs, pairs of pairs and so on, so
    memory stays at a few integers per word.
    """
    n = len(words)
    if n <= width:
        return 0
    order = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(order) == n:
        return 0
    ids = np.fromiter(map(order.__getitem__, words), dtype=np.int64, count=n)
    ranks, span = ids, 1
    for bit in bin(width)[3:]:
        ranks = np.unique(ranks[:-span] * (ranks.max() + 1) + ranks[span:], return_inverse=True)[1]
        span *= 2
        if bit == "1":
            ranks = np.unique(ranks[:-1] * len(order) + ids[span:], return_inverse=True)[1]
            span += 1
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    edges = np.zeros(n + 1, dtype=np.int32)
    edges[starts] += 1
    edges[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:n]) > 0))


def line_fails(line: str, words: list[bytes], rules: LineRules, boilerplate: re.Pattern) -> str | None:
    """The first rule that a line with at least one word breaks, or None."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > 2 * rules.max_symbol_words * n:
        marked = sum(len(w) > 1 and sum(w.count(c.encode()) for c in SYMBOLS) >= 2 for w in words)
        if marked > rules.max_symbol_words * n:
            return "symbols"
    if line.count("!!") > rules.max_shout_words * n:
        return "shouting"
    if n >= rules.min_words and sum(map(eq, words, words[1:])) > rules.max_stutter_words * n:
        return "stutter"
    if sum(map(line.count, SEPARATORS)) >= rules.min_separators:
        separators = sum(w.decode("utf-8", "surrogatepass") in SEPARATORS for w in words)
        if separators >= rules.min_separators and separators > rules.max_separators * n:
            return "navigation"
    if n <= rules.max_unstopped_words and line.rstrip(SPACES)[-1] not in STOPS:
        return "punctuation"
    if n <= rules.max_boilerplate_words and boilerplate.search(line.lower()):
        return "boilerplate"
    return None


def judge(text: str, rules: LineRules, boilerplate: re.Pattern) -> tuple:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, lost_chars, cleaned)``."""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(words)
    lost = failed = seen = duplicates = 0
    kept_lines, lines = [], set()
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            kept_lines.append(line)
            continue
        seen += 1
        duplicates += line in lines
        lines.add(line)
        if line_fails(line, own, rules, boilerplate):
            failed += 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            kept_lines.append(line)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and lost <= rules.max_loss * word_chars
    return n_words, word_chars, n_symbols, duplicates, n_repeat, base_failed, kept, seen, failed, lost, "\n".join(kept_lines)


FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, n_failed_lines bigint, lost_chars bigint"
)


def line_first_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules | None = None, cleaned: bool = False
) -> DataFrame:
    """One row per row of ``docs``: the id, whole-text counts, and the verdict.

    Words are runs without ASCII white space. Each line with a word is held
    against the rules on symbols, shouting, stutter, navigation, punctuation and
    boilerplate; failing lines go. A document is kept unless it has fewer than
    ``min_words`` words, too many words in repeated five-word windows, or lost
    more than ``max_loss`` of its word characters with the failing lines. With
    ``cleaned`` the remaining text follows as ``clean_text``.

    A null text counts as empty: all counts 0, base_failed true. Null ids and
    repeated rows pass through; other columns are ignored, whatever their names.
    """
    rules = rules or LineRules()

    def start():
        pattern = re.compile(BOILERPLATE)

        def work(texts: list[str]) -> list[tuple]:
            rows = list(zip(*[judge(t, rules, pattern) for t in texts], strict=True))
            return rows if cleaned else rows[:-1]

        return work

    schema = FIELDS + (", clean_text string" if cleaned else "")
    return over_texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text", schema, start).withColumnRenamed("id", id_col)
