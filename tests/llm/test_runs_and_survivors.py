import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tagweave.llm.codes import canonical_code
from tagweave.llm.runs import collapse_runs
from tagweave.llm.survivors import FieldRule, best_records, field_survivors

T0 = dt.datetime(2020, 1, 1)
# Columns named like the operator's own are only along for the ride.
EVENTS = "cam string, frame string, t timestamp_ntz, v string, c boolean, e string, i int, us bigint, b string"


def events(seed, n=500):
    rng = random.Random(seed)
    out, t = [], T0
    label = {"a": "X-1", "b": "X-1"}
    for k in range(n):
        cam = rng.choice("aaab")
        t += dt.timedelta(seconds=rng.choice([0, 1, 5, 5, 5, 60, 61, 4000] if rng.random() < 0.3 else [0, 1, 2]))
        if rng.random() < 0.2:
            label[cam] = rng.choice(["X-1", "X-2", "X-10", "Y-1"])
        full = rng.random() < 0.85
        v = label[cam] if full else label[cam][: rng.randint(1, 3)]
        v = None if rng.random() < 0.05 else v
        out.append((cam, f"f{k:04d}", t, v, full))
    out += out[:25]
    return [(*r, "z", 1, 2, None) for r in out] + [(None, "n1", T0, "X-1", True, None, None, None, None), ("a", None, T0, "X-1", True, None, None, None, None), ("a", "n2", None, "X-1", True, None, None, None, None), ("a", "n3", T0, "Q", None, None, None, None, None)]


def brute(rows, gap=60.0):
    out = []
    for cam in sorted({r[0] for r in rows if r[0]}):
        own = {}
        for r in rows:
            if r[0] == cam and r[1] and r[2] and r[3] is not None:
                c = bool(r[4])
                if r[1] not in own or (r[2], not c, r[3]) < (own[r[1]][0], not own[r[1]][2], own[r[1]][1]):
                    own[r[1]] = (r[2], r[3], c)
        seq = sorted((t, f, v, c) for f, (t, v, c) in own.items())
        value = []
        for k, (_, _, v, c) in enumerate(seq):
            if not c:
                p = next((x[2] for x in reversed(seq[:k]) if x[3]), None)
                n = next((x[2] for x in seq[k + 1 :] if x[3]), None)
                if p is not None and p == n and p.startswith(v):
                    v = p
            value.append(v)
        run = []
        for k, (t, f, _, _) in enumerate(seq):
            if run and (value[k] != run[-1][2] or (t - run[-1][0]).total_seconds() > gap):
                out.append((cam, run[0][2], run[0][1], run[-1][1], len(run), (run[-1][0] - run[0][0]).total_seconds()))
                run = []
            run.append((t, f, value[k]))
        if run:
            out.append((cam, run[0][2], run[0][1], run[-1][1], len(run), (run[-1][0] - run[0][0]).total_seconds()))
    return sorted(out)


def collapsed(spark, rows, **k):
    df = spark.createDataFrame(rows, EVENTS)
    out = collapse_runs(df, F.col("cam"), F.col("frame"), F.col("t"), F.col("v"), F.col("c"), **k)
    return sorted((r.entity, r.value, r.first_id, r.last_id, r.n_events, r.duration_s) for r in out.collect())


@pytest.mark.parametrize("seed, bucket", [(1, 60), (2, 600), (3, 3600), (4, 10**7)])
def test_runs_equal_a_loop_whatever_the_buckets(spark, seed, bucket):
    rows = events(seed)
    assert collapsed(spark, rows, bucket_s=bucket) == brute(rows)


def with_lost_ends(rows, gap=60.0):
    """The rows with every complete-looking reading that lost its end mended, by looping."""
    own = {}
    for r in rows:
        if r[0] and r[1] and r[2] and r[3] is not None and ((r[0], r[1]) not in own or (r[2], not r[4], r[3]) < (own[r[0], r[1]][2], not own[r[0], r[1]][4], own[r[0], r[1]][3])):
            own[r[0], r[1]] = r
    out = []
    for cam in {c for c, _ in own}:
        seq = sorted((r for r in own.values() if r[0] == cam), key=lambda r: (r[2], r[1]))
        for k, r in enumerate(seq):
            p = next((j for j in range(k - 1, -1, -1) if seq[j][4]), None)
            n = next((j for j in range(k + 1, len(seq)) if seq[j][4]), None)
            v = r[3]
            if r[4] and p is not None and n is not None and seq[p][3] == seq[n][3] != v and seq[n][3].startswith(v):
                if all((seq[j + 1][2] - seq[j][2]).total_seconds() <= gap for j in range(p, n)):
                    v = seq[n][3]
            out.append((*r[:3], v, *r[4:]))
    return out


@pytest.mark.parametrize("seed, bucket", [(1, 10), (2, 60), (3, 600), (4, 3600), (5, 10**7)])
def test_readings_that_lost_a_revision_are_mended(spark, seed, bucket):
    rng = random.Random(seed)
    rows, t, label = [], T0, "C-2/1"
    for k in range(600):
        t += dt.timedelta(seconds=rng.choice([0, 1, 5, 20, 40, 60, 61, 4000] if rng.random() < 0.3 else [0, 1, 2]))
        if rng.random() < 0.05:
            label = rng.choice(["C-2/1", "C-2/12", "C-2", "C-21"])
        cut = rng.choice([label, label, label, label, label[:3], label[:-1], label[:2], None])
        rows.append((rng.choice("aab"), f"f{k:04d}", t, cut, cut is None or len(cut) > 2, None, None, None, None))
    rows += rows[:25]
    mended = with_lost_ends(rows)
    assert sorted((r[0], r[1], r[3]) for r in mended) != sorted({(r[0], r[1], r[3]) for r in rows if r[3]})
    assert collapsed(spark, rows, bucket_s=bucket, shape_only=True) == brute(mended)


def test_a_lost_revision_in_a_stretch_of_codes(spark):
    read = ["122218-LK-R-00002589-2/1", "122218-LK-R-00002589-2", "122218-LK-R-000", "122218-LK-R-00002589-2/1"]
    rows = [(f"f{k}", T0 + dt.timedelta(seconds=40 * k), v) for k, v in enumerate(read)]
    df = spark.createDataFrame(rows, "f string, t timestamp_ntz, c string").select("f", "t", F.inline(F.array(canonical_code(F.col("c")))))
    out = collapse_runs(df, F.lit("cam"), F.col("f"), F.col("t"), F.col("value"), F.col("complete"), shape_only=True).collect()
    assert [(r.value, r.first_id, r.last_id, r.n_events) for r in out] == [(read[0], "f0", "f3", 4)]


def test_runs_of_nothing_and_of_one(spark):
    assert collapsed(spark, []) == []
    one = [("a", "f", T0, "X", True, None, None, None, None)]
    assert collapsed(spark, one) == [("a", "X", "f", "f", 1, 0.0)]


def test_gap_exactly_at_the_limit_and_value_back_in_one_bucket(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", f"f{k}", at(s), v, True, None, None, None, None) for k, (s, v) in enumerate([(0, "X"), (60, "X"), (120.001, "X"), (121, "Y"), (122, "X"), (3605, "X")])]
    assert [(r[2], r[3]) for r in collapsed(spark, rows)] == [("f0", "f1"), ("f2", "f2"), ("f4", "f4"), ("f5", "f5"), ("f3", "f3")] or [(r[2], r[3]) for r in sorted(collapsed(spark, rows), key=lambda r: r[2])] == [("f0", "f1"), ("f2", "f2"), ("f3", "f3"), ("f4", "f4"), ("f5", "f5")]


def test_one_hot_entity_is_spread_over_tasks(spark):
    rows = [("hot", f"f{k:05d}", T0 + dt.timedelta(seconds=30 * k), "X", True, None, None, None, None) for k in range(3000)]
    assert collapsed(spark, rows) == [("hot", "X", "f00000", "f02999", 3000, 30.0 * 2999)]


RECORDS = "label string, id bigint, product string, size string, valid boolean, conf double, t timestamp_ntz, m string, __g int, __id string"


def records(seed, n=300):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    out = [(pick("A", "B", "C", None, *[f"L{k}" for k in range(60)]), k if rng.random() > 0.02 else None, pick(None, "", " ", "p1", "p2"), pick(None, "M", "L"), pick(True, False, None), pick(None, 0.5, 0.5, 0.9), pick(None, T0, T0 + dt.timedelta(1)), None, 1, "x") for k in range(n)]
    return out + out[:40]


def low(v):
    return (v is not None, v)


def test_field_survivors_equal_sorting(spark):
    rows = records(3)
    df = spark.createDataFrame(rows, RECORDS)
    ranks = (F.coalesce(F.col("valid"), F.lit(False)), F.col("conf"), F.col("t"))
    got = {r.group_key: tuple(r)[1:] for r in field_survivors(df, F.col("label"), F.col("id"), {"product": FieldRule(F.col("product"), ranks), "size": FieldRule(F.col("size"), ranks)}).collect()}
    want = {}
    for g in {r[0] for r in rows if r[0]}:
        own = {r for r in rows if r[0] == g and r[1] is not None}
        if len({r[1] for r in own}) >= 2:
            best = []
            for f in (2, 3):
                fit = [r for r in own if r[f] and r[f].strip()]
                top = max(fit, key=lambda r: (bool(r[4]), low(r[5]), low(r[6]), r[1])) if fit else None
                best += [top and top[1], top and top[f]]
            want[g] = tuple(best)
    assert got == want


def test_best_whole_record(spark):
    df = spark.createDataFrame(records(4), RECORDS)
    got = best_records(df, F.col("label"), F.col("id"), [F.col("product"), F.col("size")], (F.col("conf"),), {"product": F.col("product")}).collect()
    assert len(got) == len({r.group_key for r in got}) and all(r.record_id is not None for r in got)
    rows = {r for r in records(4) if r[0] and r[1] is not None}
    for r in got:
        own = [x for x in rows if x[0] == r.group_key]
        filled = lambda x: sum(bool(x[f] and x[f].strip()) for f in (2, 3))
        assert r.record_id == max(own, key=lambda x: (filled(x), low(x[5]), x[1]))[1]


def test_survivors_of_nothing(spark):
    df = spark.createDataFrame([], RECORDS)
    assert field_survivors(df, F.col("label"), F.col("id"), {"p": FieldRule(F.col("product"), ())}).count() == 0
    assert best_records(df, F.col("label"), F.col("id"), [F.col("product")], (), {}).count() == 0
    with pytest.raises(ValueError):
        field_survivors(df, F.col("label"), F.col("id"), {}, 3)
