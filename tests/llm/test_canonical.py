import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm.canonical import CONFUSED, _codes, _distances, canonical_entries, similar_tokens

FIELD_LABELS = {"color": ("COLOR", "COL", "CLR"), "size": ("SIZE", "SZ"), "product": ("ITEM", "STYLE", "NO")}

LISTS = [("color", c) for c in ("DARK SAND", "DARK LEMON", "MOSSY OAK BARK", "INK", "RUST/CREAM", "SMOKED PLUM", "BLACK", None, "", "INK")] + [("size", s) for s in ("M", "L", "XL", "L-TALL", "OSFA", "1X")] + [("product", p) for p in ("TR35182", "TR35182Y", "H0763", "48043X")]


def mapped(spark, values, lists=LISTS, labels=FIELD_LABELS, **k):
    v = spark.createDataFrame(values, "list_name string, raw_value string, words string, entry string, t int")
    e = spark.createDataFrame(lists, "list_name string, entry string")
    rows = canonical_entries(v, e, labels, **k).collect()
    assert len({(r.list_name, r.raw_value) for r in rows}) == len(rows)
    return {(r.list_name, r.raw_value): r.entry for r in rows}


CASES = {
    "color": {
        "dark sand": "DARK SAND", "SAND, DARK": "DARK SAND", "DARKSAND": "DARK SAND", "D4RK 5AND": "DARK SAND", "DAR KSAND;": "DARK SAND", "DRK SND": "DARK SAND", "Clr: DARK SAND": "DARK SAND", "COLOR INK": "INK",
        "RUST/CRÉA": "RUST/CREAM", "SMOKED-LPUM": "SMOKED PLUM", "MOSS YOAK B": "MOSSY OAK BARK", "NK, I": "INK", "no ink": "(none)", "NO PRINT VISIBLE": "(none)", "????": "(none)", "9Q7ZVQX XZVQ": "(none)", "B1ACK": "BLACK",
    },
    "size": {"l": "L", "Sz. Xl": "XL", "size: M": "M", "LT-ALL": "L-TALL", "0SFA": "OSFA", "OSSFA": "OSFA", "##": "(none)", "UNKNOWN": "(none)", "IX": "1X"},
    "product": {"T.R35182Y": "TR35182Y", "No. TR35182": "TR35182", "#H0763": "H0763", "Item: 7R35182": "TR35182", "TR3518Z": "TR35182", "H763": "H0763", "9YYJ9V": "(none)", "4B043X": "48043X"},
}


def test_known_values(spark):
    want = {(k, v): e for k, c in CASES.items() for v, e in c.items()}
    rows = [(*k, None, None, 1) for k in want] * 2
    got = mapped(spark, [*rows, ("color", None, None, None, 1), ("color", " \t", None, None, 1), (None, "INK", None, None, 1), ("unlisted", "INK", None, None, 1), ("color", "Q" * 5000, None, None, 1)])
    assert {k: got[k] for k in want} == want
    assert got[("unlisted", "INK")] == "(none)" and got[("color", "Q" * 5000)] == "(none)" and len(got) == len(want) + 2


def test_nothing_in_nothing_out(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, [("color", "INK", None, None, 1)], []) == {("color", "INK"): "(none)"}


def test_ties_go_to_the_first_entry(spark):
    assert mapped(spark, [("size", "AXBC", None, None, 1)], [("size", "ADBC"), ("size", "AEBC")]) == {("size", "AXBC"): "ADBC"}


def test_entries_of_one_word_and_many_losses(spark):
    colors = [("color", c) for c in ("CHARCOAL", "NAVYBLUE", "BURGUNDY", "WHITE", "PEPPERCORN", "FROSTED GRAPHITE")]
    want = {"CHRCL": "CHARCOAL", "NVYBL": "NAVYBLUE", "PEPPERC": "PEPPERCORN", "FRSTDGRAPHT": "FROSTED GRAPHITE", "the white": "(none)", "white white": "WHITE"}
    got = mapped(spark, [("color", v, None, None, 1) for v in want], colors)
    assert {v: got[("color", v)] for v in want} == want


def test_label_words_are_learned_from_the_values(spark):
    entries = [("color", c) for c in ("RED", "GREEN", "BLUE", "SAND", "BLACK TEE")]
    values = [("color", f"{w}: {c}", None, None, 1) for w in ("Shade", "Black") for c in ("red", "green", "blue")] + [("color", "shade - snd", None, None, 1), ("color", "hue: red", None, None, 1)]
    got = mapped(spark, values, entries, None)
    assert got[("color", "Shade: red")] == "RED" and got[("color", "shade - snd")] == "SAND" and got[("color", "hue: red")] == "(none)"
    assert got[("color", "Black: green")] != "GREEN" or got[("color", "Black: green")] == "(none)"


def test_blocks_of_the_vocabulary_change_nothing(spark):
    values = [(k, v, None, None, 1) for k, c in CASES.items() for v in c]
    assert mapped(spark, values, block=3) == mapped(spark, values)


def slow_distance(a, b):
    kin = {ch: i for i, c in enumerate(CONFUSED) for ch in c}
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    add = [0.7 if y in "AEIOU" else 1.0 for y in b]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0:
                d[i][j] = sum(add[:j])
                continue
            if j == 0:
                d[i][j] = float(i)
                continue
            x, y = a[i - 1], b[j - 1]
            change = 0 if x == y else 0.25 if kin.get(x, -1) == kin.get(y, -2) else 1
            d[i][j] = min(d[i - 1][j - 1] + change, d[i - 1][j] + (0.6 if i > 1 and a[i - 2] == x else 1), d[i][j - 1] + add[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 0.8)
    return d[-1][-1]


def altered(rng, t):
    t = list(t)
    for _ in range(rng.randint(0, max(1, len(t) // 2))):
        at, kind = rng.randrange(len(t) + 1), rng.randrange(4)
        if kind == 0:
            t[at:at] = rng.choice("AEIOUBCD0123")
        elif kind == 1:
            t[at : at + 1] = []
        elif kind == 2:
            t[at : at + 1] = rng.choice("AE04OQ8B")
        else:
            t[at : at + 2] = t[at : at + 2][::-1]
    return "".join(t)


def test_similar_tokens_equal_all_pairs_at_every_length():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("ABCDEILNORSTUQ0158") for _ in range(n)) for n in (1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12, 16, 24, 48, 90)]
    tokens = [altered(rng, v) for v in vocabulary for _ in range(12)] + ["", "Q" * 450, "A", "8"]
    for floor in (0.4, 0.65, 1.0):
        want = {(i, j): s for i, a in enumerate(tokens) for j, b in enumerate(vocabulary) if (s := 1 - slow_distance(a, b) / max(len(a), len(b), 1)) >= floor - 1e-12}
        i, j, sim = similar_tokens(tokens, vocabulary, floor, some=50)
        got = dict(zip(zip(i.tolist(), j.tolist()), sim))
        assert got.keys() == want.keys() and len(got) == len(i)
        assert np.allclose([got[k] for k in want], list(want.values()))
    assert all(len(x) == 0 for x in (*similar_tokens([], vocabulary, 0.5), *similar_tokens(tokens, [], 0.5)))


@pytest.mark.parametrize("a, b, want", [("ABC", "ABC", 0), ("ACB", "ABC", 0.8), ("ABBC", "ABC", 0.6), ("BC", "ABC", 0.7), ("AB", "ABC", 1.0), ("0BC", "OBC", 0.25), ("", "", 0), ("", "AB", 1.7), ("AB", "", 2)])
def test_distance(a, b, want):
    assert _distances(*_codes([a]), *_codes([b]))[0] == pytest.approx(want) == slow_distance(a, b)
