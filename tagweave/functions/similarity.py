"""String similarities: edit distance and the Jaro-Winkler variant with half transpositions and an unconditional prefix bonus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.runtime import let

_TRIM = r"^\s+|\s+$"


def folded(text: Column) -> Column:
    """Without outer white space, in capitals: the form in which values are compared."""
    return F.upper(F.regexp_replace(text, _TRIM, ""))


def edit_similarity(a: Column, b: Column) -> Column:
    """``1 - levenshtein / longer length``; 1 for two empty texts, null if either is null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro_winkler_score(s: str, t: str) -> float:
    """Jaro-Winkler of two texts: matches within half the longer length less one, transposed pairs counted by halves, up to
    four common leading characters adding a tenth of the remainder each, at any Jaro value."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    free, hits = list(t), []
    for i, ch in enumerate(s):
        try:
            j = free.index(ch, max(0, i - reach), min(len(t), i + reach + 1))
        except ValueError:
            continue
        free[j] = ""
        hits.append((ch, j))
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(ch != t[j] for (ch, _), j in zip(hits, sorted(j for _, j in hits)))
    jaro = (m / len(s) + m / len(t) + (m - moved / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(s), len(t)) and s[prefix] == t[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler by Arrow batches; null if either text is null."""
    return pd.Series([None if x is None or y is None else jaro_winkler_score(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler_native(a: Column, b: Column) -> Column:
    """The same score as a fold in the JVM: matched positions are collected as ``i * 1000 + j`` (texts under 1,000 characters)."""

    def score(x: Column) -> Column:
        s, t = x["s"], x["t"]
        n, m = F.length(s), F.length(t)
        reach = F.greatest(F.floor(F.greatest(n, m) / 2) - 1, F.lit(0)).cast("int")
        none = F.array().cast("array<int>")

        def take(acc: Column, i: Column) -> Column:
            places = F.sequence(F.greatest(F.lit(1), i - reach), F.greatest(F.least(m, i + reach), F.greatest(F.lit(1), i - reach)))
            fits = F.filter(places, lambda j: (j <= m) & (F.substring(t, j, 1) == F.substring(s, i, 1)) & ~F.exists(acc, lambda k: k % 1000 == j))
            return F.when(F.size(fits) > 0, F.concat(acc, F.array(i * 1000 + F.element_at(fits, 1)))).otherwise(acc)

        def finish(hits: Column) -> Column:
            k = F.size(hits)
            chars = F.transform(hits, lambda h: F.substring(s, F.floor(h / 1000).cast("int"), 1))
            order = F.transform(F.array_sort(F.transform(hits, lambda h: h % 1000)), lambda j: F.substring(t, j, 1))
            moved = F.size(F.filter(F.zip_with(chars, order, lambda p, q: p != q), lambda v: v))
            jaro = (k / n + k / m + (k - moved / 2) / k) / 3
            same = [F.substring(s, 1, i) == F.substring(t, 1, i) for i in range(1, 5)]
            prefix = sum((F.when((n >= i) & (m >= i) & c, 1).otherwise(0) for i, c in enumerate(same, 1)), F.lit(0))
            return F.when(k == 0, F.lit(0.0)).otherwise(jaro + prefix * 0.1 * (1 - jaro))

        fold = F.aggregate(F.sequence(F.lit(1), n), none, take)
        return F.when(s == t, F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(let(fold, finish))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("s"), b.alias("t")), score))


def combined_similarity(a: Column, b: Column) -> Column:
    """The greater of edit similarity and Jaro-Winkler of the folded texts."""
    x, y = folded(a), folded(b)
    return F.greatest(edit_similarity(x, y), jaro_winkler(x, y))


def is_match(a: Column, b: Column, least: float = 0.8) -> Column:
    """Whether the combined similarity reaches ``least`` (inclusive)."""
    return combined_similarity(a, b) >= least
