import datetime as dt
import json
import random
import statistics

from pyspark.sql import functions as F

from tagweave.operators import metrics as M
from tagweave.operators.cooldown import cooldown_samples
from tagweave.plans.pipeline import Pipeline, Stage, guard, reached_stage
from tagweave.sources import sinks

T0 = dt.datetime(2020, 1, 1)


def test_median_equals_sorting(spark):
    rng = random.Random(2)
    rows = [(b, x) for b, n in (("a", 1001), ("b", 500), ("c", 1), (None, 4), ("d", 3)) for x in [rng.choice([rng.random() * 1e6, 7.0, -1.0]) for _ in range(n)]] + [("a", None), ("e", None)]
    got = {r.b: (r.n, r.median_ms) for r in M.latency_stats(spark.createDataFrame(rows, "b string, ms double"), ["b"], "ms").collect()}
    want = {b: [x for k, x in rows if k == b and x is not None] for b in {k for k, _ in rows}}
    assert got == {b: (len(v), statistics.median(v) if v else 0.0) for b, v in want.items()}
    assert M.latency_stats(spark.createDataFrame([], "b string, ms double"), ["b"], "ms").count() == 0


def test_error_frames(spark):
    df = spark.createDataFrame([("b1", "f1", "bad"), ("b1", "f1", "bad"), ("b1", "f2", None), ("b2", "f3", "bad"), (None, "f4", "bad"), ("b2", "f5", "worse")], "b string, f string, e string")
    assert sorted((r.b or "", r.f) for r in M.error_frames(df, "b", "f", F.col("e"), "bad").collect()) == [("", "f4"), ("b1", "f1"), ("b2", "f3")]


def test_each_stage_runs_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(len(b))
            yield b

    stages = tuple(Stage(f"s{i}", lambda d: d.mapInPandas(count, d.schema), F.col("n") >= i, f"e{i}") for i in range(3))
    got = Pipeline("n", stages).apply(spark.range(4).select(F.col("id").alias("n")))
    assert {r.n: r.error for r in got.collect()} == {0: "e1", 1: "e2", 2: None, 3: None} and ran.value == 4 + 4 + 3


def test_batch_summary(spark):
    rows = [("a", True, {"total": 10.0}), ("a", False, {"s2": 4.0}), ("a", None, None), (None, True, {"total": 5.0})]
    df = spark.createDataFrame(rows, "b string, ok boolean, t map<string,double>")
    got = {r.b: r for r in M.batch_summary(df, [F.col("b")], F.col("ok"), F.col("t")).collect()}
    a = got["a"]
    assert (a.total, a.successful, a.failed, a.success_rate, a.avg_ms, a.min_ms, a.max_ms, a.avg_fps) == (3, 1, 2, 33.33, 5.0, 0.0, 10.0, 200.0)
    assert got[None].success_rate == 100.0
    assert M.batch_summary(df.where("false"), [F.col("b")], F.col("ok"), F.col("t")).count() == 0
    assert {r.stage: r.avg_ms for r in M.stage_averages(df, F.col("t")).collect()} == {"total": 7.5, "s2": 4.0}


def test_latency_and_comparison(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("a", 7.0), ("b", 2.0), ("b", None), ("c", None)], "k string, ms double")
    stats = M.latency_stats(df, ["k"], "ms")
    got = {r.k: r for r in stats.collect()}
    assert (got["a"].n, got["a"].mean_ms, got["a"].median_ms) == (4, 4.0, 4.0) and abs(got["a"].std_ms - 6.5**0.5) < 1e-9
    assert (got["c"].n, got["c"].mean_ms, got["c"].std_ms) == (0, 0.0, 0.0)
    c = M.compare_backends(stats, "k", "a", "b").first()
    assert (c.gain_percent, c.faster, c.difference_ms) == (50.0, "b", 2.0)
    assert M.compare_backends(stats, "k", "c", "c").first().faster == "c"
    assert M.compare_backends(stats, "k", "a", "missing").count() == 0


def test_triage_has_a_grand_total(spark):
    df = spark.createDataFrame([("x", "f1", "bad"), ("x", "f2", None), ("y", "f3", None), (None, "f4", "bad")], "b string, f string, e string")
    got = {(r.b, r.is_total): (r.total, r.errors, r.error_rate) for r in M.error_triage(df, "b", F.col("e"), "bad").collect()}
    assert got == {("x", False): (2, 1, 50.0), ("y", False): (1, 0, 0.0), (None, False): (1, 1, 100.0), (None, True): (4, 2, 50.0)}
    files = spark.createDataFrame([("f1",), ("f1",), ("f2",)], "g string")
    there, missing = M.error_files(df, "f", F.col("e"), "bad", files, "g")
    assert [r.f for r in there.collect()] == ["f1"] and [r.f for r in missing.collect()] == ["f4"]


def test_verdicts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(M.metric_verdict(F.lit(x))) for x in (0.01, -0.03, 0.05)] == ["negligible", "acceptable", "significant"]
    assert [one(M.generalization_verdict(F.lit(a), F.lit(b))) for a, b in ((0.04, -0.04), (-0.2, 0.0), (0.06, 0.0))] == ["good", "overfit", "moderate"]
    assert one(M.first_failing_stage([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c")])) == "b"


def frames(seed, n=400):
    rng = random.Random(seed)
    out, t = [], {}
    for i in range(n):
        cam = rng.choice(["a", "a", "b", "c"])
        t[cam] = t.get(cam, T0) + dt.timedelta(seconds=rng.choice([0, 0.5, 1, 2, 5, 900]))
        out.append((cam, f"f{i:04d}", t[cam], rng.random() < 0.7))
    return [*out, *out[:20], (None, "x", T0, True), ("a", None, T0, True), ("a", "y", None, True)]


def expected_samples(rows, cooldown=2.0):
    out = set()
    for cam in {r[0] for r in rows if r[0]}:
        last = None
        for _, f, t, ok in sorted({r for r in rows if r[0] == cam and r[1] and r[2]}, key=lambda r: (r[2], r[1])):
            if last is None or (t - last).total_seconds() >= cooldown:
                out.add((cam, f))
                last = t if ok else last
    return out


def test_cooldown_equals_loop(spark):
    for seed in range(3):
        rows = frames(seed)
        df = spark.createDataFrame(rows, "cam string, f string, t timestamp_ntz, ok boolean")
        got = [(r.cam, r.f) for r in cooldown_samples(df, "cam", "f", "t", F.col("ok"), 2.0, bucket_s=60).collect()]
        assert len(got) == len(set(got)) and set(got) == expected_samples(rows)
    assert cooldown_samples(df.where("false"), "cam", "f", "t", F.col("ok")).count() == 0


def test_gap_exactly_at_cooldown(spark):
    rows = [("a", "1", T0, True), ("a", "2", T0 + dt.timedelta(seconds=2), True), ("a", "3", T0 + dt.timedelta(seconds=3.9), True)]
    df = spark.createDataFrame(rows, "cam string, f string, t timestamp_ntz, ok boolean")
    assert sorted(r.f for r in cooldown_samples(df, "cam", "f", "t", F.col("ok")).collect()) == ["1", "2"]


def test_rolling_mean_across_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, T0 + dt.timedelta(minutes=i // 3), float(rng.randint(0, 99))) for i in range(500)]
    df = spark.createDataFrame(rows, "e string, i int, t timestamp_ntz, v double")
    got = {(r.e, r.i): (r.n, r.rolling_mean) for r in M.rolling_mean(df, "e", F.date_trunc("hour", "t"), ["t", "i"], "v", last=7, block=10).collect()}
    assert len(got) == 500
    for e in "ab":
        own = sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1]))
        for k, r in enumerate(own):
            last = [x[3] for x in own[max(0, k - 6) : k + 1]]
            assert got[(e, r[1])] == (k + 1, sum(last) / len(last))


def test_pipeline_short_circuits_and_keeps_failures(spark):
    calls = Stage("s2", lambda d: d.withColumn("found", F.col("n") > 0), F.col("found"), "No label detected")
    code = Stage("s5", lambda d: d.withColumn("code", F.when(F.col("n") > 1, F.col("n") * 10)), F.col("code").isNotNull(), "No QR code detected")
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", None)], "k string, n int")
    got = {r.k: (r.success, r.error, r.stage, r.code) for r in Pipeline("k", (calls, code)).apply(df).collect()}
    assert got == {"a": (False, "No label detected", "s2", None), "b": (False, "No QR code detected", "s5", None), "c": (True, None, None, 20), "d": (False, "No label detected", "s2", None)}
    off = Stage("s3", lambda d: d, F.lit(True), "Preprocessing failed", enabled=False, error_off="Preprocessing disabled")
    assert {r.error for r in Pipeline("k", (calls, off, code)).apply(df).collect()} == {"No label detected", "Preprocessing disabled"}
    skipped = Stage("s4", lambda d: d.withColumn("x", F.lit(1)), F.lit(False), "no", enabled=False, when_off="pass")
    assert {r.k: r.success for r in Pipeline("k", (calls, skipped, code)).apply(df).collect()} == {"a": False, "b": False, "c": True, "d": False}
    assert Pipeline("k", (calls, code)).apply(df.where("false")).count() == 0
    assert [spark.range(1).select(reached_stage(F.lit(e).cast("string"))).first()[0] for e in ("No label detected", "No QR code detected", None)] == [2, 5, 8]
    pts = spark.createDataFrame([(b"x", [1, 2, 3]), (None, [1, 2, 3]), (b"x", [1]), (b"x", None)], "i binary, p array<int>")
    assert [r[0] for r in pts.select(guard(F.col("i"), F.col("p"))).collect()] == [True, False, False, False]


def test_records_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("b1", "f1", True, {"total": 20.0, "s2": 4.0}), ("b1", "f2", False, None)], "b string, f string, ok boolean, t map<string,double>")
    text = df.select(sinks.stage_record("s2", F.col("f"), ok=F.col("ok"), gone=F.lit(None).cast("string"))).first()[0]
    assert json.loads(text) == {"frameId": "f1", "ok": True, "gone": None}
    assert not sinks.write_records(df, sinks.DebugSwitch(str(tmp_path / "d")), "s2") and not (tmp_path / "d").exists()
    assert sinks.write_records(df, sinks.DebugSwitch(str(tmp_path / "d"), True), "s2") and spark.read.json(str(tmp_path / "d/s2")).count() == 2
    t = df.select(sinks.frame_timing(F.col("f"), F.lit("2020"), F.col("t")).alias("x")).collect()
    assert (t[0].x.summary.total_ms, t[0].x.summary.fps) == (20.0, 50.0)
    r = sinks.batch_report(df, "b", "f", F.col("ok"), F.col("t"), F.lit(None)).first()
    assert r.batch_info.total_images == 2 and r.timing_summary.batch_total_ms == 20.0 and r.step_averages_ms == {"s2": 4.0, "total": 20.0}
