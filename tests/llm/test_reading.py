import random

import numpy as np
from pyspark.sql import functions as F

from tagweave.llm.reading import Settings, Words, fit, fit_words, reading_levels, word_count

VOCABULARY = [[f"{stem}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] for stem in ("low", "mid", "high", "top")]
FOREIGN = [f"fremd{chr(97 + i)}" for i in range(26)]
DOCS, LABELS = "doc_id bigint, text string, lang string, labels int, band string", "doc_id bigint, band int, rater string, lang string"


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    docs, truth = [], {}
    sentence = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(5, 14))) + "."
    for i in range(n):
        band = rng.randrange(4)
        other = rng.randrange(4)
        parts = [sentence(VOCABULARY[band]) for _ in range(7)] + [sentence(VOCABULARY[other]) for _ in range(3)]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), rng.choice(["en", "EN", "en-US", None]), 1, "x"))
        truth[i] = band + 1
    docs += [(n + i, " ".join(sentence(FOREIGN) for _ in range(6)), rng.choice(["de", None, "de"]), 1, "x") for i in range(60)]
    docs += [(2000, VOCABULARY[0][0], "en", 1, "x"), (2001, "", "en", 1, "x"), (2002, None, "en", 1, "x"), (None, "a b", "en", 1, "x"), docs[0], docs[0], (2003, " ".join(rng.choice(VOCABULARY[2]) for _ in range(40_000)), "fr", 1, "x")]
    labels = []
    for i in range(0, n, 4):
        for rater in ("r1", "r2"):
            off = rng.choice([0] * 9 + [1])
            labels.append((i, min(4, truth[i] + off), rater, "x"))
    return docs, truth, labels + labels[:5] + [(5, None, "r1", "x"), (6, 9, "r1", "x"), (None, 2, "r1", "x"), (99_999, 2, "r1", "x")]


def levels(spark, docs, labels, **k):
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    return {r.doc_id: r for r in reading_levels(d, F.col("doc_id"), F.col("text"), F.col("lang"), lab, F.col("doc_id"), F.col("band"), F.col("rater"), Settings(slots=1 << 14, **k)).collect()}


def test_held_out_documents_get_their_band(spark):
    docs, truth, labels = corpus()
    got = levels(spark, docs, labels)
    assert got.keys() == {d[0] for d in docs if d[0] is not None and d[1] is not None}
    held = [i for i in truth if i % 4]
    assert sum(got[i].band == truth[i] for i in held) / len(held) > 0.95
    assert not any(got[i].is_english for i in range(400, 460)) and all(got[i].is_english for i in truth)
    assert got[2001].n_words == 0 and got[2001].confidence is None and got[2000].n_words == 1
    assert got[2003].n_words == 40_000 and got[2003].band == 3 and got[2003].is_english


def test_same_result_on_any_partitioning(spark):
    docs, _, labels = corpus(5, 120)
    a = levels(spark, docs, labels)
    b = levels(spark, docs[::-1], labels[::-1])
    assert {k: v.band for k, v in a.items()} == {k: v.band for k, v in b.items()}


def test_without_labels_or_documents(spark):
    docs, _, labels = corpus(4, 40)
    assert levels(spark, docs, []) == {} and levels(spark, [], labels) == {} and levels(spark, docs, [(1, None, "r", "x")]) == {}


def test_words(spark):
    df = spark.createDataFrame([("a  b\n\tc",), ("",), (" ",), (None,), ("x y",)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [3, 0, 0, 0, 2]


def test_difficulties_are_recovered_from_counts():
    rng = np.random.default_rng(1)
    true = Words(rng.uniform(0.5, 4.5, 400), rng.uniform(0.3, 2.5, 400), np.array([0.3, 0.3, 0.25, 0.15]))
    p = true.base * np.exp(true.ratios())
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    counts = np.stack([rng.multinomial(2_000_000, x / x.sum()) for x in p.astype(float)])
    # The words' own shares of levels need not add up to the base; an offset word makes them do.
    counts = np.concatenate([counts, np.maximum(0, true.base * 4e9 - counts.sum(0))[None]])
    got = fit_words(counts.astype(float), 1e-6)
    assert np.abs(got.base - true.base).max() < 1e-3
    assert np.abs(got.discrimination[:-1] - true.discrimination).max() < 0.2 and np.abs(got.difficulty[:-1] - true.difficulty).max() < 0.3
    odds = np.exp(got.ratios()[:, 1:] - got.ratios()[:, :-1])
    assert np.allclose(odds, np.exp(got.discrimination[:, None] * (got.difficulty[:, None] - [1.5, 2.5, 3.5])), rtol=1e-3)


def test_words_that_tell_nothing_and_unseen_words_have_no_say():
    got = fit_words(np.array([[100.0, 100, 100, 100], [0, 0, 0, 0], [0, 0, 0, 50], [50, 0, 0, 0], [0, 50, 50, 0]]))
    assert np.abs(got.ratios()[:2]).max() < 0.1 and got.difficulty[2] > 3 > 2 > got.difficulty[3]


def test_model_is_recovered_from_texts_with_few_labels(spark):
    rng = np.random.default_rng(7)
    letters = lambda i: "w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    true = Words(rng.uniform(0.5, 4.5, 300), rng.uniform(0.5, 2.5, 300), np.full(4, 0.25))
    p = np.exp(true.ratios().astype(float))
    p /= p.sum(0)
    band = rng.integers(1, 5, 600)
    docs = [(i, " ".join(" ".join(letters(w) for w in rng.choice(300, 12, p=p[:, b - 1])) + "." for _ in range(8)), "en", 1, "x") for i, b in enumerate(band)]
    labels = [(i, int(band[i]), "r", "x") for i in range(0, 600, 8)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    s = Settings(slots=1 << 14, passes=12)
    f = fit(d, F.col("doc_id"), F.col("text"), F.col("lang"), lab, F.col("doc_id"), F.col("band"), F.col("rater"), s)
    slots = [r[0] for r in spark.createDataFrame([(letters(i),) for i in range(300)], "w string").coalesce(1).select(F.pmod(F.xxhash64("w"), F.lit(s.slots))).collect()]
    assert np.corrcoef(np.clip(f.words.difficulty[np.searchsorted(f.slots, slots)], 0, 5), true.difficulty)[0, 1] > 0.95
    assert f.gains == sorted(f.gains) and 1 < len(f.gains) < 12 and f.gains[-1] - f.gains[-2] <= 1e-3 * f.gains[-2]
    got = {r.doc_id: r.band for r in f.levels().collect()}
    assert np.mean([got[i] == band[i] for i in range(600) if i % 8]) > 0.95
