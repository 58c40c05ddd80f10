"""Differences between two revisions: rows, bags, sets, ranges and lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def entry_diff(base: DataFrame, head: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``(key, status)`` of entries added, deleted or changed in any value, nulls being values."""
    b = base.select(F.col(key), F.struct(*values).alias("b"))
    h = head.select(F.col(key), F.struct(*values).alias("h"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "deleted").when(~F.col("b").eqNullSafe(F.col("h")), "changed")
    return b.join(h, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def bag_difference(head: DataFrame, base: DataFrame, first: list[str], second: list[str], order: list[str]) -> DataFrame:
    """Head rows that no base row accounts for.

    Equal rows on ``first`` cancel one by one; what is left on both sides cancels
    one by one on ``second``. Within equals, head rows go in the given order.
    """

    def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    for keys in (first, second):
        h, b = numbered(head, keys), numbered(base, keys)
        condition = F.lit(True)
        for k in [*keys, "_n"]:
            condition = condition & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
        head, base = (
            h.alias("x").join(b.alias("y"), condition, "left_anti").drop("_n"),
            b.alias("x").join(h.alias("y"), condition, "left_anti").drop("_n"),
        )
    return head


def broadened(head: DataFrame, base: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Head rows with no equal set in the base, and whether one there is a proper subset.

    Sets are compared as they are stored, sorted and unique, among rows with equal
    keys.
    """
    h = head.withColumn("_row", F.monotonically_increasing_id())
    b = base.select(*keys, F.col(items).alias("_old"))
    subset = (F.size(F.array_except("_old", items)) == 0) & (F.size("_old") < F.size(items))
    told = h.join(b, keys, "left").groupBy("_row").agg(
        F.coalesce(F.bool_or(F.col("_old") == F.col(items)), F.lit(False)).alias("exact"),
        F.coalesce(F.bool_or(subset), F.lit(False)).alias("broadened"),
    )
    return h.join(told, "_row").where("not exact").drop("_row", "exact")


def feature_growth(head: DataFrame, base: DataFrame, keys: list[str], features: str, defaults: str | None = None) -> DataFrame:
    """Head edges that are new, or have features that the base edge lacks: ``(keys, change, added)``."""
    h = head.select(*keys, F.col(features).alias("_new"), *([F.col(defaults).alias("_dn")] if defaults else []))
    b = base.select(*keys, F.col(features).alias("_old"), *([F.col(defaults).alias("_do")] if defaults else []), F.lit(True).alias("_known"))
    added = F.array_sort(F.array_except("_new", F.coalesce("_old", F.array().cast("array<string>"))))
    opened = F.col("_dn") & ~F.col("_do") if defaults else F.lit(False)
    change = F.when(F.col("_known").isNull(), "new").when((F.size("added") > 0) | opened, "expanded")
    return h.join(b, keys, "left").withColumn("added", added).withColumn("change", change).where("change is not null").select(*keys, "change", "added")


def touched(ranges: DataFrame, lines: DataFrame, key: str, start: str, end: str, line: str) -> DataFrame:
    """Ranges that hold at least one of the lines of their key."""
    found = ranges.alias("r").join(lines.alias("l"), (F.col(f"r.{key}") == F.col(f"l.{key}")) & F.col(f"l.{line}").between(F.col(f"r.{start}"), F.col(f"r.{end}")), "left_semi")
    return found


class BudgetExceeded(RuntimeError):
    """A line diff needed more cells than allowed."""


#: The distance of cells outside the band.
_FAR = 1 << 29


def added_line_numbers(base: list, head: list, budget: int = 25_000_000) -> list[int]:
    """1-based head lines outside a longest common subsequence, deletions first among ties.

    A common prefix is skipped, then the distances between all rests are filled
    in a band around the diagonal, as wide as the lengths differ at first and
    doubled until the distance is at most the band: a path that leaves it costs
    more. A band of more than ``budget`` cells raises :class:`BudgetExceeded`.
    """
    skip = 0
    while skip < min(len(base), len(head)) and base[skip] == head[skip]:
        skip += 1
    names = {v: i for i, v in enumerate(dict.fromkeys([*base[skip:], *head[skip:]]))}
    a = np.array([names[v] for v in base[skip:]], dtype=np.int64)
    b = np.array([names[v] for v in head[skip:]], dtype=np.int64)
    if not len(a) or not len(b):
        return list(range(skip + 1, skip + len(b) + 1))
    whole, width = max(len(a), len(b)), budget // (len(a) + 1)
    most = whole if width > len(b) else (width - 1) // 2
    band = abs(len(a) - len(b))
    while True:
        cells = (len(a) + 1) * min(2 * band + 1, len(b) + 1)
        if cells > budget:
            raise BudgetExceeded(f"{cells} cells exceed the budget of {budget}")
        table = _distances(a, b, band)
        if table[0, 0] <= band or band == whole:
            break
        wider = min(max(2 * band, 1), whole, most)
        if wider <= band:
            raise BudgetExceeded(f"a band wider than {band} exceeds the budget of {budget} cells")
        band = wider

    def distance(i: int, j: int) -> int:
        low = max(0, i - band)
        return int(table[i, j - low]) if low <= j <= min(len(b), i + band) else _FAR

    i = j = 0
    added = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif distance(i + 1, j) <= distance(i, j + 1):
            i += 1
        else:
            added.append(skip + j + 1)
            j += 1
    return added + list(range(skip + j + 1, skip + len(b) + 1))


def _distances(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Insertions and deletions from each rest of ``a`` to each of ``b``, at most ``band`` off the diagonal.

    Row ``i`` begins with column ``max(0, i - band)``.
    """
    table = np.full((len(a) + 1, min(2 * band + 1, len(b) + 1)), _FAR, dtype=np.int32)
    for i in range(len(a), -1, -1):
        low, high = max(0, i - band), min(len(b), i + band)
        at = np.arange(low, high + 1, dtype=np.int32)
        if i == len(a):
            table[i, : len(at)] = len(b) - at
            continue
        below = np.full(len(at) + 1, _FAR, dtype=np.int32)  # the next row's columns low to high + 1
        first, last = max(0, i + 1 - band), min(len(b), i + 1 + band)
        start, end = max(low, first), min(high + 1, last)
        below[start - low : end - low + 1] = table[i + 1, start - first : end - first + 1]
        best = below[:-1] + 1
        inner = min(high + 1, len(b)) - low
        best[:inner] = np.where(b[low : low + inner] == a[i], below[1 : inner + 1], best[:inner])
        if high == len(b):
            best[-1] = len(a) - i
        table[i, : len(at)] = np.minimum.accumulate((best + at)[::-1])[::-1] - at
    return table


def added_lines(pairs: DataFrame, key: str, base: str, head: str, budget: int = 25_000_000) -> DataFrame:
    """``(key, line, status)``: added head lines of each pair of line-hash arrays.

    Pairs whose arrays are equal never reach Python. A pair over the budget gives
    one row with a null line and status ``budget``.
    """
    changed = pairs.where(~F.col(base).eqNullSafe(F.col(head))).select(F.col(key).alias("k"), F.col(base).alias("b"), F.col(head).alias("h"))
    kind = changed.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, b, h in zip(batch["k"], batch["b"], batch["h"], strict=True):
                try:
                    out += [(k, n, "ok") for n in added_line_numbers(list(b) if b is not None else [], list(h) if h is not None else [], budget)]
                except BudgetExceeded:
                    out.append((k, None, "budget"))
            yield pd.DataFrame(out, columns=["k", "line", "status"]).astype({"line": "Int32"})

    return changed.mapInPandas(run, f"k {kind}, line int, status string").withColumnRenamed("k", key)


def hunk_lines(patches: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line)``: head lines that the hunk headers of unified diffs name."""
    header = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    starts, counts = F.regexp_extract_all(text, F.lit(header), F.lit(1)), F.regexp_extract_all(text, F.lit(header), F.lit(2))
    hunks = patches.select(key, F.explode(F.arrays_zip(starts.alias("s"), counts.alias("n"))).alias("x"))
    n = F.when(F.col("x.n") == "", 1).otherwise(F.col("x.n").cast("int"))
    first = F.col("x.s").cast("int")
    return hunks.where(n > 0).select(key, F.explode(F.sequence(first, first + n - 1)).alias("line")).distinct()
