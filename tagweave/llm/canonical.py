"""Free-entered values mapped to the entry of a reference list that they stand for: token repair, then soft TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.runtime import cut_lineage, is_blank

NONE = "(none)"
# Characters that recognition confuses, one class a text; the first stands for its class.
CONFUSED = ("O0QD", "I1L", "Z2", "S5", "B8", "G6", "A4", "E3", "T7")
# Latin letters with marks and the plain letters they are read as.
_MARKED = ("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOOUUUUY")


_CODE = np.full(128, 36, np.int64)  # of capitals and digits; words hold nothing else
_CODE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = np.arange(36)
_CLASS = np.arange(37)
for _c in CONFUSED:
    _CLASS[_CODE[[ord(x) for x in _c]]] = _CODE[ord(_c[0])]
_INSERT = np.ones(37)
_INSERT[_CODE[[ord(x) for x in "AEIOU"]]] = 0.7
_UNSEEN = 0.25  # entries that a word counts as being in if it is in none
# Costs of the other edits: a confused character, a character read twice, neighbours swapped.
_CONFUSED, _TWICE, _SWAP = 0.25, 0.6, 0.8


def _words(value: Column) -> Column:
    """The value's words: capitals without marks, cut at everything that is no letter or digit."""
    up = F.translate(F.upper(value), *_MARKED)
    return F.filter(F.split(up, "[^A-Z0-9]+"), lambda w: w != "")


def _codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens' characters in one row each, filled up behind, and the tokens' lengths."""
    size = np.array([len(t) for t in tokens], np.int64)
    out = np.full((len(tokens), int(size.max(initial=0)) + 1), 36, np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = _CODE[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
    return out, size


def _distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distances with neighbour swaps from the read tokens ``a`` to the entries' ``b``, all pairs at once; cheaper are confused
    characters, a character read twice, and a vowel left out."""
    pairs, wide = len(la), int(lb.max(initial=0))
    b, out = b[:, : wide + 1], np.zeros(pairs)
    insert = _INSERT[b]
    before, row = None, np.concatenate([np.zeros((pairs, 1)), np.cumsum(insert[:, :wide], 1)], 1)
    ends = np.arange(pairs)
    out[la == 0] = row[ends, lb][la == 0]
    for i in range(int(la.max(initial=0))):
        x = a[:, i]
        extra = np.where(x == a[:, i - 1], _TWICE, 1.0) if i else np.ones(pairs)
        change = np.where(x[:, None] == b, 0.0, np.where(_CLASS[x][:, None] == _CLASS[b], _CONFUSED, 1.0))
        nxt = np.empty_like(row)
        nxt[:, 0] = i + 1.0
        best = np.minimum(row[:, :-1] + change[:, :wide], row[:, 1:] + extra[:, None])
        if i and wide > 1:
            swap = (x[:, None] == b[:, : wide - 1]) & (a[:, i - 1][:, None] == b[:, 1:wide])
            best[:, 1:] = np.where(swap, np.minimum(best[:, 1:], before[:, : wide - 1] + _SWAP), best[:, 1:])
        for j in range(wide):
            nxt[:, j + 1] = np.minimum(best[:, j], nxt[:, j] + insert[:, j])
        before, row = row, nxt
        last = la == i + 1
        out[last] = row[ends[last], lb[last]]
    return out


def _bags(codes: np.ndarray) -> np.ndarray:
    """How often each class of confused characters occurs in each token."""
    of = _CLASS[codes]
    out = np.bincount((np.arange(len(of))[:, None] * 37 + of).ravel(), minlength=len(of) * 37).reshape(len(of), 37)[:, :36]
    return np.minimum(out, 32_000).astype(np.int16)


def similar_tokens(tokens: list[str], vocabulary: list[str], floor: float, some: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of all pairs of a token and a vocabulary word with a similarity (1 less the distance over the longer length) of ``floor`` at
    least, and the similarity. What the tokens' characters leave over at least bounds the distance from below, so only pairs that may
    reach ``floor`` are compared; none that does is missed."""
    found: list[tuple[np.ndarray, ...]] = []
    codes_b, lb = _codes(vocabulary)
    bags_b, longest = _bags(codes_b), int(lb.max(initial=0))
    for lo in range(0, len(tokens), some):
        # A token so long that its surplus alone is too dear is similar to no word.
        part = [k for k in range(lo, min(lo + some, len(tokens))) if (len(tokens[k]) - longest) * _TWICE <= (1 - floor) * len(tokens[k]) + 1e-9]
        if not part or not len(vocabulary):
            continue
        codes_a, la = _codes([tokens[k] for k in part])
        over = np.maximum(_bags(codes_a)[:, None, :] - bags_b[None, :, :], 0).sum(2, dtype=np.int64)
        short = over - la[:, None] + lb[None, :]
        least = np.minimum(over, short) + _TWICE * np.maximum(over - short, 0) + _INSERT.min() * np.maximum(short - over, 0)
        top = np.maximum(np.maximum(la[:, None], lb[None, :]), 1)
        i, j = np.nonzero(least <= (1 - floor) * top + 1e-9)
        order = np.argsort(la[i] + lb[j], kind="stable")
        for at in np.array_split(order, max(1, len(order) // 20_000)):
            ii, jj = i[at], j[at]
            sim = 1 - _distances(codes_a[ii], la[ii], codes_b[jj], lb[jj]) / top[ii, jj]
            keep = sim >= floor - 1e-12
            found.append((np.array(part)[ii[keep]], jj[keep], sim[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _repairer(blocks: object, floors: dict[str, float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows ``list_name, kind, a`` to ``list_name, kind, a, t, sim`` of the words ``t`` of the broadcast vocabulary that ``a`` is similar to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (name, kind), part in batch.groupby(["list_name", "kind"]):
                words = blocks.value.get((name, kind), [])
                tokens = part["a"].tolist()
                i, j, sim = similar_tokens(tokens, words, floors[kind])
                if len(i):
                    yield pd.DataFrame({"list_name": name, "kind": kind, "a": [tokens[x] for x in i], "t": [words[x] for x in j], "sim": sim})

    return run


def _repaired(tokens: DataFrame, vocabulary: DataFrame, floors: dict[str, float], block: int) -> DataFrame:
    """All similar pairs of tokens and vocabulary words: the words are the query set, broadcast in blocks of ``block``."""
    spark = tokens.sparkSession
    spread = tokens.repartition(spark.sparkContext.defaultParallelism, "a")
    spread, schema, out, held, n = cut_lineage(spread), "list_name string, kind string, a string, t string, sim double", None, {}, 0

    def compared(held: dict) -> DataFrame:
        return spread.mapInPandas(_repairer(spark.sparkContext.broadcast(held), floors), schema)

    for row in vocabulary.orderBy("list_name", "kind", "t").toLocalIterator():
        held.setdefault((row["list_name"], row["kind"]), []).append(row["t"])
        n += 1
        if n == block:
            out = compared(held) if out is None else out.unionByName(compared(held))
            held, n = {}, 0
    if held:
        out = compared(held) if out is None else out.unionByName(compared(held))
    return spark.createDataFrame([], schema) if out is None else out


def _learned_labels(base: DataFrame, lists: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """``list_name, label``: first words of values that stand before at least ``share`` of the list's entries (and three), spelt right, and are
    no word of an entry themselves."""
    first = base.where(F.size("words") > 1).select("list_name", F.element_at("words", 1).alias("label"), F.array_join(F.slice("words", F.lit(2), F.size("words")), "").alias("whole"))
    seen = first.join(lists.select("list_name", "whole"), ["list_name", "whole"]).groupBy("list_name", "label").agg(F.count_distinct("whole").alias("n")).join(sizes, "list_name").where(F.col("n") >= F.greatest(F.lit(3), F.col("size") * share))
    own = lists.select("list_name", F.explode("words").alias("label")).distinct()
    return seen.select("list_name", "label").join(own, ["list_name", "label"], "left_anti")


def canonical_entries(
    values: DataFrame, entries: DataFrame, labels: dict[str, tuple[str, ...]] | None = None, accept: float = 0.65, token_floor: float = 0.4, label_share: float = 0.05, block: int = 4096
) -> DataFrame:
    """``list_name, raw_value, entry, score``: one row per distinct pair of ``values`` (``list_name STRING, raw_value STRING``).

    ``entries`` (``list_name, entry``) are the reference lists; ``labels`` names, per list, words in capitals that may precede a value,
    besides those that the values show: words that stand before ``label_share`` of the list's entries. The entry is ``(none)``
    where no entry reaches ``accept``.

    Method: the distinct tokens of the values (words, and all words run together, in either order for values of several) are
    joined to the vocabulary of the lists by edit distance: the vocabulary is the query set, compared with all tokens in
    blocks of ``block`` words (which bounds the broadcast), behind a bound on the distance that misses nothing. Entries are
    ranked by soft TF-IDF over the repaired words, or by the similarity of the run-together tokens where that is
    greater; words that repair to nothing, or to a word that another repairs to better, weigh as words that no entry has. A tie goes to the entry whose words come in the
    value's order, then to the first in the alphabet.

    Defined results: null and blank values are left out; values without any letter or digit are ``(none)``; an empty list leaves
    all its values ``(none)``; entries that are null or blank are ignored, and repeated ones count once.
    """
    name, whole = F.col("list_name"), F.array_join("words", "")
    lists = entries.where(~is_blank(F.col("entry")) & name.isNotNull()).select("list_name", "entry").distinct()
    lists = cut_lineage(lists.withColumn("words", _words(F.col("entry"))).withColumn("whole", whole))  # read by every step below
    posted = lists.select("list_name", "entry", F.explode(F.array_distinct("words")).alias("t"))
    sizes = lists.groupBy("list_name").agg(F.count("*").alias("size"))
    idf = posted.groupBy("list_name", "t").agg(F.count("*").alias("df")).join(sizes, "list_name").select("list_name", "t", F.log(1 + F.col("size") / F.col("df")).alias("idf"))
    posted = posted.join(idf, ["list_name", "t"])
    norms = posted.groupBy("list_name", "entry").agg(F.sum(F.col("idf") * F.col("idf")).alias("norm"))
    posted = cut_lineage(posted.join(norms, ["list_name", "entry"]))
    vocabulary = lists.select("list_name", F.lit("whole").alias("kind"), F.col("whole").alias("t")).unionByName(posted.select("list_name", F.lit("word").alias("kind"), "t")).where("t <> ''").distinct()

    base = values.where(~is_blank(F.col("raw_value")) & name.isNotNull()).select("list_name", "raw_value").distinct()
    base = cut_lineage(base.withColumn("words", _words(F.col("raw_value"))))
    named = [(k, x) for k, v in (labels or {}).items() for x in v]
    known = _learned_labels(base, lists, sizes, label_share).unionByName(base.sparkSession.createDataFrame(named, "list_name string, label string")).distinct()
    open_ = base.withColumn("label", F.when(F.size("words") > 1, F.element_at("words", 1))).join(known.withColumn("led", F.lit(True)), ["list_name", "label"], "left")
    open_ = open_.select("list_name", "raw_value", F.when(F.col("led"), F.slice("words", F.lit(2), F.size("words"))).otherwise(F.col("words")).alias("words"))
    open_ = open_.where("size(words) > 0").withColumn("whole", whole)

    tokens = open_.select("list_name", "raw_value", F.size("words").alias("n"), F.explode(F.array_compact(F.array(
        F.struct(F.lit("whole").alias("kind"), F.col("whole").alias("a"), F.lit(1).alias("straight")),
        F.when(F.size("words") > 1, F.struct(F.lit("whole").alias("kind"), F.array_join(F.reverse("words"), "").alias("a"), F.lit(0).alias("straight"))),
    ))).alias("x")).select("list_name", "raw_value", "n", "x.*")
    tokens = tokens.unionByName(open_.select("list_name", "raw_value", F.size(F.array_distinct("words")).alias("n"), F.lit("word").alias("kind"), F.explode(F.array_distinct("words")).alias("a"), F.lit(0).alias("straight")))
    tokens = cut_lineage(tokens)
    repaired = cut_lineage(_repaired(tokens.select("list_name", "kind", "a").distinct(), vocabulary, {"whole": accept, "word": token_floor}, block))

    by_whole = tokens.where("kind = 'whole'").join(repaired.where("kind = 'whole'"), ["list_name", "kind", "a"])
    by_whole = by_whole.join(lists.select("list_name", "entry", F.col("whole").alias("t")), ["list_name", "t"]).select("list_name", "raw_value", "entry", F.col("sim").alias("score"), "straight")

    hits = tokens.where("kind = 'word'").join(repaired.where("kind = 'word'"), ["list_name", "kind", "a"]).join(posted, ["list_name", "t"])
    best = hits.groupBy("list_name", "raw_value", "entry", "a").agg(F.max(F.struct("sim", "idf", "t")).alias("m"), F.max("n").alias("n"), F.max("norm").alias("norm"))
    best = best.groupBy("list_name", "raw_value", "entry", "m.t").agg(F.max("m.sim").alias("sim"), F.max("m.idf").alias("idf"), F.max("n").alias("n"), F.max("norm").alias("norm"))
    square = F.col("idf") * F.col("idf")
    scored = best.groupBy("list_name", "raw_value", "entry").agg(
        F.sum(square * F.col("sim")).alias("num"), F.sum(square).alias("found"), F.count("*").alias("k"), F.max("n").alias("n"), F.max("norm").alias("norm")
    ).join(sizes, "list_name")
    unseen = F.log(1 + F.col("size") / F.lit(_UNSEEN))
    strange = (F.col("n") - F.col("k")) * unseen * unseen
    by_words = scored.select("list_name", "raw_value", "entry", (F.col("num") / F.sqrt((F.col("found") + F.greatest(strange, F.lit(0))) * F.col("norm"))).alias("score"), F.lit(0).alias("straight"))

    ranked = by_whole.unionByName(by_words).where(F.col("score") >= accept).withColumn("score", F.round("score", 9))
    order = F.row_number().over(W.partitionBy("list_name", "raw_value").orderBy(F.desc("score"), F.desc("straight"), "entry"))
    first = ranked.withColumn("rn", order).where("rn = 1").select("list_name", "raw_value", "entry", "score")
    return base.select("list_name", "raw_value").join(first, ["list_name", "raw_value"], "left").select("list_name", "raw_value", F.coalesce("entry", F.lit(NONE)).alias("entry"), F.coalesce("score", F.lit(0.0)).alias("score"))
