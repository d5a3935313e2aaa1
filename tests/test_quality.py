import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators import profile as P
from tagweave.operators.reconcile import Field, close_to, differing_keys, reconcile

FORMS = {"code": P.Form("^[Aa9]{3,9}$"), "day": P.Form("^9{6}$", "MMddyy")}


def counts(spark, rows):
    # Columns whose names clash with those used inside are harmless.
    df = spark.createDataFrame(rows, "load string, code string, day string, at timestamp, value string, n int, column_name string")
    c = {"code": F.col("code"), "day": F.col("day")}
    return P.value_counts(df, F.col("load"), c, {"day": P.code_date(F.col("day"))}, F.col("at"))


def test_masks(spark):
    got = spark.createDataFrame([("AB-12c",), ("",), (None,), ("É1é",)], "v string").select(P.mask(F.col("v")), P.short_mask(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("AA-99a", "A+-9+a"), ("", ""), (None, None), ("Ü9ü", "Ü9ü")]


@pytest.mark.parametrize("code, real", [("022920", True), ("022919", False), ("123218", False), ("12181", False), ("1218AB", False), (None, None)])
def test_code_date(spark, code, real):
    got = spark.createDataFrame([(code,)], "v string").select(P.code_date(F.col("v"))).first()[0]
    assert (got is not None) == bool(real)


def test_findings_at_their_thresholds(spark):
    at = dt.datetime(2019, 1, 10)
    rows = [("a", f"AB{i % 7}X", "010119", at, "x", 1, "y") for i in range(17)] + [("a", None, "010115", at, None, None, None), ("a", " ", "010119", at, None, None, None), ("a", "", "010115", at, None, None, None)]
    rows += [("b", "?", "990119", at, "x", 1, "y")] * 3 + [("b", f"AB{i % 7}X", "010119", at, "x", 1, "y") for i in range(17)]
    rows += [("c", "SAME1", None, at, "x", 1, "y")] * 20 + [("d", f"AB{i % 7}X", "010117", at, "x", 1, "y") for i in range(40)]
    rows += [(None, "AB1X", "010119", at, None, None, None)]
    found = P.findings(P.profile(counts(spark, rows), FORMS), with_mix=("code",), with_range=("day",))
    got = {tuple(r) for r in found.collect()}
    assert got == {("a", "code", "nulls"), ("b", "code", "pattern"), ("b", "day", "pattern"), ("c", "code", "mix"), ("c", "day", "nulls"), ("d", "day", "range"), (None, "code", "mix")}  # rows without a load are a load of their own


def test_empty_table_has_no_findings(spark):
    c = counts(spark, [])
    assert P.profile(c, FORMS).count() == 0 and P.rare_masks(c).count() == 0 and P.drift_between(c).count() == 0 and P.mask_drift(c).count() == 0


def test_drift_is_symmetric_and_bounded(spark):
    at = dt.datetime(2019, 1, 1)
    rows = [("1", "AAA", "010119", at, None, None, None)] * 5 + [("2", "999", "010119", at, None, None, None)] * 5 + [("3", "999", None, at, None, None, None)] * 2
    got = {(r["load"], r.column_name): r.divergence for r in P.drift_between(counts(spark, rows)).collect()}
    assert got[("2", "code")] == 1.0 and got[("3", "code")] == 0.0 and got[("2", "day")] == 0.0 and ("3", "day") not in got
    whole = {(r["load"], r.column_name): r.divergence for r in P.mask_drift(counts(spark, rows)).collect()}
    assert 0 < whole[("1", "code")] < 1 and whole[("1", "day")] == 0.0


SCHEMA = "f string, d int, conf double, box array<int>, name string, at timestamp, bucket string, key string, __key string"


def brute(left, right):
    def current(rows):
        out = {}
        for f, d, c, b, n, at, *_ in rows:
            if f is None or d is None:
                continue
            k = (f.strip().lower(), d)
            low = lambda v: (v is not None, v)
            this = (low(at), low(c), low(b), low(n and n.strip().lower()))
            out[k] = max(out.get(k, this), this)
        return out

    l, r = current(left), current(right)
    found = {(*k, "only_l") for k in l.keys() - r.keys()} | {(*k, "only_r") for k in r.keys() - l.keys()}
    for k in l.keys() & r.keys():
        (_, a, b, n), (_, c, d, m) = l[k], r[k]
        if a[0] != c[0] or (a[0] and abs(a[1] - c[1]) > 0.001):
            found.add((*k, "conf"))
        found |= {(*k, w) for w, x, y in (("box", b, d), ("name", n, m)) if x != y}
    return found


def run(spark, left, right, **sizes):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    out = reconcile(
        make(left), make(right), {"f": F.lower(F.trim("f")), "d": F.col("d")}, F.col("at"),
        {"conf": close_to(F.col("conf"), 0.001), "box": Field(F.col("box")), "name": Field(F.lower(F.trim("name")))}, ("l", "r"), **sizes,
    )
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def copies(n, changed, seed=5):
    rng = random.Random(seed)
    t0 = dt.datetime(2020, 1, 1)
    left = [(f"F{i // 3}", i % 3, round(rng.random(), 6), [rng.randint(0, 99) for _ in range(4)], rng.choice(["label", "tag", None]), t0 + dt.timedelta(seconds=i), "x", None, "k") for i in range(n)]
    right = []
    for r in left:
        if rng.random() < changed:
            kind = rng.randrange(6)
            if kind == 0:
                continue
            r = list(r)
            r[2] = [r[2], r[2] + 0.5, None, r[2] + 0.0005, r[2] + 0.0011, r[2]][kind]
            r[3] = None if kind == 5 else r[3]
            r[4] = "LABEL " if kind == 3 else r[4]
            right.append(tuple(r))
            if kind == 1:
                right += [tuple(r)] * 2
            if kind == 2:
                right.append((r[0].lower() + " ", r[1], 0.25, r[3], r[4], r[5] + dt.timedelta(days=1), None, None, None))
        else:
            right.append(r)
    right += [(None, 1, 0.5, None, None, t0, None, None, None), ("new", 1, None, None, None, None, None, None, None)]
    return left, right


@pytest.mark.parametrize("changed", [0.0, 0.05, 0.6, 1.0])
def test_reconcile_equals_brute_force(spark, changed):
    left, right = copies(900, changed)
    assert run(spark, left, right, rows_a_bucket=128, cells=48) == brute(left, right)


def test_reconcile_of_empty_copies(spark):
    left, _ = copies(30, 0)
    assert run(spark, [], []) == set()
    assert run(spark, left, []) == {(f.lower(), d, "only_l") for f, d, *_ in left}
    assert run(spark, [], left) == {(f.lower(), d, "only_r") for f, d, *_ in left}


def test_overfull_tables_are_still_whole(spark):
    a = spark.range(3000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    b = spark.range(3000).select(F.col("id").alias("k"), F.lit(2).alias("v"))
    keys = differing_keys(a, b, ["k"], ["v"], 3000, rows_a_bucket=3000, cells=30)
    assert keys.count() == 3000 and keys.distinct().count() == 3000
