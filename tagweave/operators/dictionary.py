"""Dictionaries of allowed values: exact membership and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.similarity import combined_similarity, folded


def load_entries(raw: DataFrame, column: str, upper: bool, place: str | None = None) -> DataFrame:
    """``entry, ord`` of a dictionary: outer white space removed (and capitals with ``upper``), blank entries dropped, repeated ones kept
    once. ``ord`` decides ties of fuzzy matching: the first ``place`` of the entry in its list, where the source tells one, else it is null and the alphabet decides."""
    text = F.regexp_replace(F.col(column).cast("string"), r"^\s+|\s+$", "")
    at = F.col(place).cast("bigint") if place else F.lit(None).cast("bigint")
    rows = raw.select((F.upper(text) if upper else text).alias("entry"), at.alias("ord")).where("entry is not null and entry <> ''")
    return rows.groupBy("entry").agg(F.min("ord").alias("ord"))


def exact_match(texts: DataFrame, text: str, entries: DataFrame, keep_case: bool = False) -> DataFrame:
    """``texts`` with ``match``: the entry that the text is, or null. Capitals are compared; with ``keep_case`` the text as it
    stands is looked up too, and the capital form is preferred. A dictionary is joined by broadcast only if Spark knows it to be small."""
    d = entries.select(F.col("entry").alias("__entry"))
    stripped = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    found = texts.join(d, F.upper(stripped) == d["__entry"], "left")
    if keep_case:
        as_is = entries.select(F.col("entry").alias("__as_is"))
        found = found.join(as_is, stripped == as_is["__as_is"], "left")
        return found.withColumn("match", F.coalesce("__entry", "__as_is")).drop("__entry", "__as_is")
    return found.withColumnRenamed("__entry", "match")


def _tokens(text: Column) -> Column:
    """The text's characters, each with its count so far, rare characters first (digits and letters late in the alphabet)."""
    chars = F.split(text, "")
    numbered = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))
    return F.reverse(F.array_sort(numbered))


def fuzzy_match(texts: DataFrame, text: str, entries: DataFrame, min_score: float = 0.9) -> DataFrame:
    """``texts`` (distinct rows of one column) with ``match`` and ``score``: the entry with the highest combined similarity
    **above** ``min_score`` (0 or more); the first entry (by ``ord``, then in the alphabet) wins a tie; no winner gives ``''`` and ``min_score``, an empty
    text or an empty dictionary ``''`` and 0.

    Candidates come from an equality join, not a cross join: a pair scoring above ``min_score`` shares so many characters
    that the rarest few of each must meet (prefix filter). The needed overlap follows from the formulas, so nothing is lost.
    """
    t = texts.select(F.col(text).alias("__raw")).distinct().withColumn("__t", folded(F.col("__raw"))).where("__t <> ''")
    e = entries.select("entry", "ord", folded(F.col("entry")).alias("__e"))
    # Jaro is at least (score - 0.4) / 0.6, and at most (m / a + m / b + 1) / 3 for m shared characters of lengths a and b; an edit
    # similarity above the score shares that part of the longer text. From the shorter text's least share of the longer one's
    # length follows how many of the rarest characters must hold a shared one; each pair is kept at its first.
    jaro = (min_score - 0.4) / 0.6
    share = max(0.0, min(3 * jaro - 2, min_score))
    kept = lambda c: F.slice(c, 1, (F.size(c) - F.ceil(F.size(c) * F.lit(share)) + 1).cast("int"))
    left = t.withColumn("__ta", _tokens(F.col("__t"))).withColumn("__pa", kept(F.col("__ta"))).withColumn("__k", F.explode("__pa"))
    right = e.withColumn("__tb", _tokens(F.col("__e"))).withColumn("__pb", kept(F.col("__tb"))).withColumn("__k", F.explode("__pb"))
    a, b = F.size("__ta"), F.size("__tb")
    needed = F.least(max(0.0, 3 * jaro - 1) * a * b / (a + b), min_score * F.greatest(a, b)) - 1e-9
    first = F.get(F.array_intersect("__pa", "__pb"), F.lit(0)) == F.col("__k")
    near = (F.least(a, b) >= F.greatest(a, b) * F.lit(share) - 1e-9) & first & (F.size(F.array_intersect("__ta", "__tb")) >= needed)
    pairs = left.join(right, "__k").where(near).select("__raw", "__t", "entry", "ord", "__e")
    scored = pairs.withColumn("score", combined_similarity(F.col("__t"), F.col("__e"))).where(F.col("score") > min_score)
    first = F.struct((-F.col("score")).alias("s"), F.coalesce("ord", F.lit(0).cast("bigint")).alias("o"), F.col("entry").alias("e"))
    best = scored.groupBy("__raw").agg(F.min(first).alias("m")).select("__raw", F.col("m.e").alias("match"), (-F.col("m.s")).alias("score"))
    out = texts.join(best, texts[text] == best["__raw"], "left")
    none = folded(F.col(text)).isNull() | (folded(F.col(text)) == "") | (entries.agg(F.count("*")).scalar() == 0)
    return out.withColumns({"match": F.coalesce("match", F.lit("")), "score": F.coalesce("score", F.when(none, 0.0).otherwise(min_score))}).drop("__raw")
