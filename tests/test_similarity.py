import random

from pyspark.sql import functions as F

from tagweave.functions import similarity as S
from tagweave.operators.dictionary import exact_match, fuzzy_match, load_entries


def pairs(n=300):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ABC12") for _ in range(rng.randint(0, 9)))
    out = [(word(), word()) for _ in range(n)]
    for _ in range(n):
        w = list(word() + "AB")
        v = w[:]
        i = rng.randrange(len(v) - 1)
        v[i], v[i + 1] = v[i + 1], v[i]
        out.append(("".join(w), "".join(v)))
    return out


def test_native_and_batch_jaro_winkler_agree(spark):
    df = spark.createDataFrame(pairs(), "a string, b string")
    rows = df.select("a", "b", S.jaro_winkler("a", "b").alias("x"), S.jaro_winkler_native(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-12 for r in rows)
    assert S.jaro_winkler_score("MARTHA", "MARHTA") > 0.96 and S.jaro_winkler_score("", "A") == 0.0 and S.jaro_winkler_score("", "") == 1.0


def test_odd_transpositions_count_by_halves():
    # Three matched characters out of order: one and a half transpositions.
    assert abs(S.jaro_winkler_score("ABCXXX", "BCAYYY") - (3 / 6 + 3 / 6 + (3 - 3 / 2) / 3) / 3) < 1e-12


def test_edit_similarity(spark):
    df = spark.createDataFrame([("", ""), ("", "AB"), ("ABC", "ABD"), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(S.edit_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 - 1 / 3, None]


def test_blocking_loses_nothing(spark):
    texts = spark.createDataFrame([(a,) for a, _ in pairs(150)] + [("",), (" ab ",)], "t string").distinct()
    entries = load_entries(spark.createDataFrame([(b,) for _, b in pairs(150)], "e string"), "e", True)
    words = [r.entry for r in entries.orderBy("ord", "entry").collect()]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    for least in (0.3, 0.7, 0.8, 0.9):
        for r in fuzzy_match(texts, "t", entries, least).collect():
            t, best, score = r.t.strip().upper(), "", least
            for w in words if t else ():
                s = max(edits(t, w), S.jaro_winkler_score(t, w))
                if s > score:
                    best, score = w, s
            assert (r.match, round(r.score, 9)) == (best, round(score if t else 0.0, 9))


def test_fuzzy_results_without_winner(spark):
    texts = spark.createDataFrame([("",), ("ZZZZ",), ("DARK SAN",)], "t string")
    entries = load_entries(spark.createDataFrame([("dark sand",), ("",), (None,), ("DARK SAND",)], "e string"), "e", True)
    got = {r.t: (r.match, round(r.score, 4)) for r in fuzzy_match(texts, "t", entries, 0.9).collect()}
    assert got[""] == ("", 0.0) and got["ZZZZ"] == ("", 0.9) and got["DARK SAN"][0] == "DARK SAND"
    none = spark.createDataFrame([], "entry string, ord int")
    assert {(r.match, r.score) for r in fuzzy_match(texts, "t", none, 0.9).collect()} == {("", 0.0)}


def test_exact_match_prefers_capitals(spark):
    entries = spark.createDataFrame([("ab1", 1), ("AB1", 2), ("cd", 3)], "entry string, ord int")
    texts = spark.createDataFrame([("ab1",), (" cd ",), ("x",), (None,)], "t string")
    got = {r.t: r.match for r in exact_match(texts, "t", entries, keep_case=True).collect()}
    assert got == {"ab1": "AB1", " cd ": "cd", "x": None, None: None}


def test_every_text_is_matched_against_all_three_dictionaries(spark, tmp_path):
    from tagweave.queries.labels import QUERIES

    lists = {"products": ("code", ["TR35182", "H0763AB", "Long12345"]), "sizes": ("name", ["L-TALL-LONG", "xl", "M"]), "colors": ("name", ["DARK HEATHER", "Black", "MOSSY OAK"])}
    for name, (column, entries) in lists.items():
        spark.createDataFrame([(e,) for e in entries], f"{column} string").write.parquet(f"{tmp_path}/{name}.parquet")
    texts = [("TR35182", "product"), ("TR3518Z", None), ("DARK HEATHR", "color"), ("dark heathre", "other"), ("L-TALL-LNG", "size"), ("XL", None), ("black", "product"), ("", "other"), (None, "color"), ("LONG12345", "size")]
    spark.createDataFrame(texts, "text string, zone string").write.parquet(f"{tmp_path}/ocr_blocks.parquet")
    want = set()
    for name, (_, entries) in zip(("product", "size", "color"), lists.values()):
        kept = sorted({e if name == "product" else e.upper() for e in entries})
        pairs = [(t, e) for t in {t for t, _ in texts if t is not None} for e in kept]
        df = spark.createDataFrame(pairs, "t string, e string")
        scores = df.select("t", "e", S.combined_similarity(S.folded(F.col("t")), S.folded(F.col("e"))).alias("s")).collect()
        for t in {r.t for r in scores}:
            top = min((-r.s, r.e) for r in scores if r.t == t)
            want.add((t, name, top[1], round(-top[0], 6)) if t and -top[0] > 0.9 else (t, name, "", 0.9 if t else 0.0))
    got = [tuple(r) for r in QUERIES["j2_fuzzy_match_all"](spark, str(tmp_path)).select("text", "list", "match", "score").collect()]
    assert len(got) == len(want) == 27 and set(got) == want
    assert {(r[0], r[2]) for r in got if r[2]} >= {("TR35182", "TR35182"), ("dark heathre", "DARK HEATHER"), ("XL", "XL"), ("black", "BLACK")}
