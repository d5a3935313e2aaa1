"""Reading level of documents: a Rasch-style model of word difficulties and text levels, fitted by distributed alternation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.runtime import written

# What ends a sentence, and what counts as white space.
_SENTENCE = r"(?<=[.!?;:])\s+|[\r\n]+"
_NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]+"
_WORD = r"\p{L}+|[0-9]+"
_LEAST_SHARP = 1e-3  # least discrimination of a word


@dataclass(frozen=True)
class Settings:
    """Sizes and constants of the fit. ``slots`` bounds the word table (and so every broadcast and everything that reaches the
    driver) whatever the vocabulary: words share a slot if their hashes do. ``piece`` is the greatest number of words that are
    taken as one passage of one level. The alternation ends when the log likelihood gains less than ``tolerance`` of itself, or
    after ``passes`` passes."""

    levels: int = 4
    slots: int = 1 << 18
    piece: int = 20
    purity: float = 0.9
    label_hit: float = 0.86
    label_near: float = 0.06
    prior: float = 1.0
    ridge: float = 0.5
    tolerance: float = 1e-3
    passes: int = 8


@dataclass(frozen=True)
class Words:
    """Fitted words by slot: ``difficulty`` on the scale of the levels, ``discrimination`` (least for a word that tells nothing), and the levels'
    shares of all occurrences, ``base``."""

    difficulty: np.ndarray
    discrimination: np.ndarray
    base: np.ndarray

    def ratios(self) -> np.ndarray:
        """Log likelihood of each level from one occurrence of each word, against the levels' shares. The link is logistic: the odds of
        level k + 1 against level k are those of the shares times ``exp(discrimination * (difficulty - (k + 1/2)))``."""
        levels = np.arange(1, len(self.base) + 1)
        step = self.discrimination[:, None] * (self.difficulty[:, None] - (levels[:-1] + 0.5))
        log = np.concatenate([np.zeros((len(step), 1)), np.cumsum(step, 1)], 1)
        return (log - np.log(np.exp(log) @ self.base)[:, None]).astype(np.float32)


def fit_words(counts: np.ndarray, ridge: float = 0.5, rounds: int = 12) -> Words:
    """Difficulty and discrimination of every word from its (expected) occurrences by level: the greatest likelihood of the adjacent-step
    logistic link, with a ridge on its two coefficients (Newton steps, all words at once, discrimination never below ``_LEAST_SHARP``)."""
    n, levels = counts.shape
    base = (counts.sum(0) + 1e-9) / (counts.sum() + 1e-9 * levels)
    middle = (levels + 1) / 2
    x = np.arange(1, levels + 1) - middle
    f = np.stack([x, -x * x / 2])  # linear in slope = discrimination * (difficulty - middle) and in discrimination
    total, w = counts.sum(1), np.full((n, 2), [0.0, _LEAST_SHARP])
    for _ in range(rounds):
        eta = w @ f
        p = base * np.exp(eta - eta.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mean = p @ f.T
        g = (counts - total[:, None] * p) @ f.T - ridge * w
        h11, h22, h12 = (total * (p @ (f[i] * f[j]) - mean[:, i] * mean[:, j]) for i, j in ((0, 0), (1, 1), (0, 1)))
        h11, h22 = h11 + ridge, h22 + ridge
        det = h11 * h22 - h12 * h12
        slope, sharp = (h22 * g[:, 0] - h12 * g[:, 1]) / det, (h11 * g[:, 1] - h12 * g[:, 0]) / det
        sharp = np.clip(w[:, 1] + np.clip(sharp, -2, 2), _LEAST_SHARP, 20) - w[:, 1]
        bound = w[:, 1] + sharp == _LEAST_SHARP  # there the slope alone is free
        slope = np.where(bound, (g[:, 0] - h12 * sharp) / h11, slope)
        w = np.stack([np.clip(w[:, 0] + np.clip(slope, -2, 2), -20, 20), w[:, 1] + sharp], 1)
    return Words(middle + w[:, 0] / w[:, 1], w[:, 1], base)


def word_count(text: Column) -> Column:
    """Words separated by white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_NOT_SPACE)), F.lit(0))


def _sentences(text: Column, slots: int) -> Column:
    """The text's sentences as arrays of word slots; numbers share one slot."""
    number = F.xxhash64(F.lit("0"))
    slot = lambda w: F.pmod(F.when(w < ":", number).otherwise(F.xxhash64(w)), F.lit(slots)).cast("int")
    return F.transform(F.split(F.lower(text), _SENTENCE), lambda s: F.transform(F.regexp_extract_all(s, F.lit(_WORD), F.lit(0)), slot))


def _unpack(batch: pa.RecordBatch, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``slots`` of all words, the segment of each word, the document and the share of its sentence of each segment; sentences are
    cut at ``piece`` words."""
    lists = batch.column(batch.schema.get_field_index("sizes"))
    per_doc = np.diff(lists.offsets.to_numpy())
    size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    words = batch.column(batch.schema.get_field_index("words")).flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    parts = -(-size // piece)
    seg_doc = np.repeat(doc, parts)
    within = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
    seg = np.repeat(np.cumsum(parts) - parts, size) + within // piece
    return words, seg, seg_doc, np.repeat(1.0 / np.maximum(parts, 1), parts)


def _posteriors(words: np.ndarray, seg: np.ndarray, seg_doc: np.ndarray, prior: np.ndarray, table: np.ndarray, purity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level posteriors of the segments and of the documents, and the documents' log likelihoods, given the words' log likelihoods by
    level and the documents' prior."""
    levels, n_docs = table.shape[1], len(prior)
    ll = np.stack([np.bincount(seg, table[words, k], minlength=len(seg_doc)) for k in range(levels)], 1)
    top = ll.max(1) if len(ll) else np.zeros(0)
    like = np.exp(ll - top[:, None])
    mix = np.full((levels, levels), (1 - purity) / max(1, levels - 1))
    np.fill_diagonal(mix, purity)
    fit = np.log(like @ mix)
    q = np.log(prior) + np.stack([np.bincount(seg_doc, fit[:, k], minlength=n_docs) for k in range(levels)], 1)
    high = q.max(1, keepdims=True)
    q = np.exp(q - high)
    gain = np.log(q.sum(1)) + high[:, 0] + np.bincount(seg_doc, top, minlength=n_docs)
    q /= q.sum(1, keepdims=True)
    r = like * (q @ mix)[seg_doc]
    return r / r.sum(1, keepdims=True), q, gain


def _prior(labels: np.ndarray, s: Settings) -> np.ndarray:
    """Prior of the documents' levels from their raters' label counts; flat without labels."""
    far = max(1e-3, 1 - s.label_hit - 2 * s.label_near)
    gap = np.abs(np.subtract.outer(np.arange(s.levels), np.arange(s.levels)))
    log = np.log(np.where(gap == 0, s.label_hit, np.where(gap == 1, s.label_near, far)))
    p = np.exp((lp := labels @ log) - lp.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _log_ratios(counts: np.ndarray, prior: float) -> np.ndarray:
    """Log likelihood ratios of every word by class against all classes, shrunk to 0 for rare words."""
    total = counts.sum()
    expected = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / total if total else counts
    return np.log((counts + prior) / (expected + prior)).astype(np.float32)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _labels(batch: pa.RecordBatch, levels: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("labels")).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(batch), levels).astype(np.float64)


def _sums(width: int, slots: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that adds its batches up in one table and sends its rows that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((slots, width))
        for batch in _chunks(batches):
            add(batch, table)
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(table[at, k]) for k in range(width)]], names=["slot", *[f"c{k}" for k in range(width)]])

    return run


def _gather(texts: DataFrame, width: int, slots: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sums over all texts; at most ``slots`` rows reach the driver."""
    names = [f"c{k}" for k in range(width)]
    sums = texts.mapInArrow(_sums(width, slots, add), "slot int, " + ", ".join(f"{n} double" for n in names))
    got = sums.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    table = np.zeros((slots, width))
    table[got["slot"].to_numpy(np.int64)] = got[names].to_numpy(np.float64)
    return table


def _add_words(of: Callable[[pa.RecordBatch], np.ndarray], piece: int) -> Callable[[pa.RecordBatch, np.ndarray], None]:
    """Adds each document's row of ``of`` to the slots of its words, once a document, so that one long text counts as one."""

    def add(batch: pa.RecordBatch, table: np.ndarray) -> None:
        weight = of(batch)
        words, seg, seg_doc, _ = _unpack(batch, piece)
        if len(words):
            doc, word = np.divmod(np.unique(seg_doc[seg].astype(np.int64) * len(table) + words), len(table))
            for k in range(table.shape[1]):
                table[:, k] += np.bincount(word, weight[doc, k], minlength=len(table))

    return add


def _english(words: np.ndarray, doc: np.ndarray, n_docs: int, ratios: np.ndarray, odds: float) -> np.ndarray:
    return odds + np.bincount(doc, ratios[words], minlength=n_docs) >= 0


def _once(documents: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` of every document once, the greatest text of an id. Only ids are counted over all rows; texts move
    only where an id repeats."""
    repeated = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return documents
    several = documents.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("m")).select("doc_id", "m.*")
    return documents.join(repeated, "doc_id", "left_anti").unionByName(several)


class Fit:
    """Texts as word slots, written once, and what was fitted to them: ``words`` at the occurring ``slots``, and ``gains``, the log likelihood at every pass."""

    def __init__(self, documents: DataFrame, labels: DataFrame, s: Settings) -> None:
        """``documents``: ``doc_id, text, lang``, no nulls in the first two; ``labels``: ``doc_id, labels`` with the raters' counts by level."""
        self.s, self.spark = s, documents.sparkSession
        tongue = F.lower(F.trim("lang"))
        none = F.array(*[F.lit(0).cast("bigint")] * s.levels)
        cut = _once(documents).select(
            "doc_id",
            F.when(tongue.isNull() | (tongue == ""), 0).when(tongue.startswith("en"), 1).otherwise(-1).alias("tongue"),
            word_count(F.col("text")).cast("long").alias("n_words"),
            F.inline(F.array(F.struct(_sentences(F.col("text"), s.slots).alias("sentences")))),
        )
        cut = cut.select("doc_id", "tongue", "n_words", F.transform("sentences", lambda x: F.size(x)).alias("sizes"), F.flatten("sentences").alias("words"))
        self.texts = written(cut.join(labels, "doc_id", "left").withColumn("labels", F.coalesce("labels", none)))
        kind = lambda b: np.stack([(t := _column(b, "tongue")) > 0, t < 0], 1).astype(np.float64)
        by_tongue = _log_ratios(_gather(self.texts.select("tongue", "sizes", "words"), 2, s.slots, _add_words(kind, s.piece)), s.prior)
        known = self.texts.agg(F.count_if(F.col("tongue") > 0).alias("en"), F.count_if(F.col("tongue") < 0).alias("other"), F.count_if(F.exists("labels", lambda x: x > 0)).alias("labelled")).first()
        self.labelled, self.odds = known["labelled"], float(np.log((known["en"] + 1) / (known["other"] + 1)))
        self.tongues = self.spark.sparkContext.broadcast((by_tongue[:, 0] - by_tongue[:, 1]).astype(np.float32))
        self.words, self.slots, self.gains = fit_words(np.zeros((0, s.levels))), np.zeros(0, np.int64), []
        self.table = None
        if self.labelled:
            self._alternate()

    def _alternate(self) -> None:
        s, inputs = self.s, self.texts.select("labels", "sizes", "words")
        table = np.zeros((s.slots, s.levels), np.float32)
        for step in range(s.passes + 1):
            shared = self.spark.sparkContext.broadcast(table)
            sums = _gather(inputs, s.levels, s.slots + 1, self._adder(shared, step == 0))  # the last row holds the log likelihood
            shared.destroy()
            seen = np.flatnonzero(sums[:-1].any(1))
            self.words = fit_words(sums[seen], s.ridge)
            self.slots = seen
            table = np.zeros((s.slots, s.levels), np.float32)
            table[seen] = self.words.ratios()
            if step:
                self.gains.append(float(sums[-1, 0]))
            if step > 1 and abs(self.gains[-1] - self.gains[-2]) <= s.tolerance * abs(self.gains[-2]):
                break
        self.table = self.spark.sparkContext.broadcast(table)

    def _levels_of(self, table) -> Callable[[pa.RecordBatch], tuple]:
        s, tongues, odds = self.s, self.tongues, self.odds

        def levels_of(batch: pa.RecordBatch) -> tuple:
            words, seg, seg_doc, part = _unpack(batch, s.piece)
            english = _english(words, seg_doc[seg], len(batch), tongues.value, odds)
            labels = _labels(batch, s.levels)
            return words, seg, seg_doc, part, english, labels, *_posteriors(words, seg, seg_doc, _prior(labels, s), table.value, s.purity)

        return levels_of

    def _adder(self, table, anchored: bool) -> Callable[[pa.RecordBatch, np.ndarray], None]:
        levels_of, levels = self._levels_of(table), self.s.levels

        def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
            words, seg, seg_doc, _, english, labels, r, _, gain = levels_of(batch)
            use = english & (labels.any(1) | (not anchored))
            at = use[seg_doc[seg]] if len(words) else np.zeros(0, bool)
            for k in range(levels):
                sums[:, k] += np.bincount(words[at], r[seg[at], k], minlength=len(sums))
            sums[-1, 0] += gain[english].sum()

        return add

    def levels(self) -> DataFrame:
        """``doc_id, is_english, n_words, band, level, confidence`` of every text."""
        levels_of, s = self._levels_of(self.table), self.s

        def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _chunks(batches):
                _, seg, seg_doc, part, english, _, r, q, _ = levels_of(batch)
                mass = np.stack([np.bincount(seg_doc, part * r[:, k], minlength=len(batch)) for k in range(s.levels)], 1)
                total = mass.sum(1)
                share = np.where(total[:, None] > 0, mass / np.maximum(total, 1e-9)[:, None], q)
                sure = np.where(total > 0, share.max(1), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("doc_id")),
                        pa.array(english),
                        batch.column(batch.schema.get_field_index("n_words")),
                        pa.array((share.argmax(1) + 1).astype(np.int32)),
                        pa.array(share @ np.arange(1, s.levels + 1, dtype=np.float64)),
                        pa.array(sure, from_pandas=True),
                    ],
                    names=["doc_id", "is_english", "n_words", "band", "level", "confidence"],
                )

        return self.texts.select("doc_id", "labels", "n_words", "sizes", "words").mapInArrow(final, self.schema())

    def schema(self) -> str:
        return f"doc_id {self.texts.schema['doc_id'].dataType.simpleString()}, is_english boolean, n_words long, band int, level double, confidence double"


def fit(documents: DataFrame, doc_id: Column, text: Column, lang: Column, labels: DataFrame, label_doc: Column, label_level: Column, label_rater: Column, settings: Settings = Settings()) -> Fit:
    """The model of ``reading_levels`` with its parameters."""
    docs = documents.select(doc_id.alias("doc_id"), text.alias("text"), lang.alias("lang")).where("doc_id is not null and text is not null")
    one = labels.select(label_doc.alias("doc_id"), label_level.cast("int").alias("b"), label_rater.alias("rater")).where(F.col("b").between(1, settings.levels) & F.col("doc_id").isNotNull())
    one = one.distinct().groupBy("doc_id").agg(F.array(*[F.count(F.when(F.col("b") == k + 1, 1)) for k in range(settings.levels)]).alias("labels"))
    return Fit(docs, one, settings)


def reading_levels(
    documents: DataFrame, doc_id: Column, text: Column, lang: Column, labels: DataFrame, label_doc: Column, label_level: Column, label_rater: Column, settings: Settings = Settings()
) -> DataFrame:
    """``doc_id, is_english, n_words, band, level, confidence``: one row per document with a non-null id and text.

    ``band`` (1 to ``levels``) is the level for which most of the text's sentences are written, ``level`` its mean over the
    sentences, ``confidence`` the share of the sentences at the band. ``n_words`` counts words separated by white space.

    Method: a Rasch-style model. A word has a difficulty and a discrimination, a passage (a sentence, cut at ``piece`` words) a level on the
    same scale; the log odds that an occurrence of the word belongs to level k + 1 rather than k are, against all
    occurrences, discrimination times (difficulty minus the step k + 1/2). A document's level is that of most of its passages (by
    ``purity``). Alternation: given the words, each task finds the posteriors of its passages and documents; given these, the
    expected occurrences of the words by level are summed over all documents, and difficulty and discrimination of every word are
    fitted to them by greatest likelihood. It ends when the log likelihood hardly gains (``tolerance``). Raters' labels anchor the
    scale: they start the words and stay priors of their documents, and may err. A pass sends the driver at most ``slots``
    rows and broadcasts a table of that size, however large the corpus; nothing of single documents leaves the tasks.

    Whether a text is English is told by its words: their log odds of occurring in documents whose ``lang`` says English
    against others, summed; ``lang`` of the document itself has no more say than that of any other.

    Defined results: null ids and null texts are left out; a repeated id counts once, with its greatest text; an empty text has
    0 words, the highest prior level and confidence null; null label levels or ids are ignored, repeated label rows count once, levels
    outside 1 to ``levels`` are ignored; without any usable label there is no scale and so no row; with fewer labels the words
    they don't reach are placed by the alternation alone.
    """
    f = fit(documents, doc_id, text, lang, labels, label_doc, label_level, label_rater, settings)
    return f.levels() if f.labelled else documents.sparkSession.createDataFrame([], f.schema())
