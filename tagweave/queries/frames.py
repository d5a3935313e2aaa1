"""Queries of the detection and geometry operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import geometry as G
from tagweave.functions import patterns as P
from tagweave.operators import detect as D
from tagweave.runtime import table

_W, _H = 1920, 1080  # size of the frames that the detections lie in


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge copy's detections, exact repeats and outdated versions once."""
    d = table(spark, sf_dir, "detections_edge")
    latest = d.groupBy("frame_id", "det_no").agg(F.max(F.struct("synced_at", "class_name", "confidence", "bbox")).alias("m"))
    return latest.select("frame_id", "det_no", "m.class_name", "m.confidence", "m.bbox")


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_blocks").where("bbox is not null").select("block_id", "bbox").distinct()


def c1_best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = D.best_class(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", best.alias("b")).select("vec_id", "b.class_id", F.round(F.col("b.confidence").cast("double"), 6).alias("confidence"))


def _centre(box):
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, (box[2] - box[0]).cast("double"), (box[3] - box[1]).cast("double")


def _decoded(spark: SparkSession, sf_dir: str, clip: str) -> DataFrame:
    box = D.decode_box(*_centre(F.col("bbox")), F.lit(1.5), F.lit(1.5), F.lit(_W), F.lit(_H), clip)
    return _detections(spark, sf_dir).where("bbox is not null").select("frame_id", "det_no", box.alias("b")).select("frame_id", "det_no", "b.*")


def c3_decode_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "inner")


def c3_decode_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "outer")


def c4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each vector as a detector's output of 4 by 16 numbers: fewer rows than candidates, so it is turned.
    output = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    wide = F.concat(output, F.array(F.slice("embedding", 1, 16), F.slice("embedding", 17, 16)))
    c = D.candidates(wide, 2)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(c).alias("i", "c"))
    return rows.select("vec_id", "i", F.round(F.col("c.box")[0].cast("double"), 6).alias("x"), F.round(F.col("c.scores")[1].cast("double"), 6).alias("score"))


def c5_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).where(D.passes_confidence(F.col("confidence"), 0.5) & D.small_enough(F.col("bbox"), F.lit(_W), F.lit(_H), 0.05))
    return d.select("frame_id", "det_no", D.box_area(F.col("bbox")).alias("area"))


def w1_top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_n(_detections(spark, sf_dir).where("confidence is not null"), "frame_id", "confidence", "det_no", 2).select("frame_id", "det_no", "rank")


def w2_first_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_n(_detections(spark, sf_dir).where("confidence is not null"), "frame_id", "confidence", "det_no", 1).select("frame_id", "det_no", "class_name")


def w3_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nms(_detections(spark, sf_dir), "frame_id", "confidence", "bbox", "det_no", 0.5, 0.3).select("frame_id", "det_no", "rank")


def w3_dense_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All detections of a camera within one second form one dense frame.
    d = _detections(spark, sf_dir).where("bbox is not null and confidence is not null").withColumn("dense", F.substring("frame_id", 1, 25))
    d = d.withColumn("ord", F.concat_ws("#", "frame_id", "det_no"))
    return D.nms(d, "dense", "confidence", "bbox", "ord", 0.5, 0.45).select("dense", "ord", "rank")


def d9_bounding_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("block_id", G.bounding_rect(F.col("bbox")).alias("r")).select("block_id", "r.*")


def d10_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("block_id", G.extents(F.col("bbox")).alias("e")).select("block_id", "e.*")


def d8_polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("block_id", G.area(F.col("bbox")).alias("area"))


def d8_largest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "ocr_blocks").where("bbox is not null").select("frame_id", "bbox").distinct()
    return b.groupBy("frame_id").agg(F.array_sort(F.collect_list("bbox")).alias("p")).select("frame_id", G.area(G.largest(F.col("p"))).alias("area"))


def w11_ordered_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The corners turned by one place, so that there is an order to restore.
    turned = F.concat(F.slice("bbox", 3, 2), F.slice("bbox", 1, 2))
    c = F.col("c")
    corners = _polygons(spark, sf_dir).where("size(bbox) = 4").select("block_id", G.ordered_corners(turned).alias("c"))
    return corners.select("block_id", *[c[i][j].alias(f"{n}{i + 1}") for i in range(4) for j, n in enumerate("xy")])


def e20_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("bbox")[2] - F.col("bbox")[0]), (F.col("bbox")[3] - F.col("bbox")[1])
    f = P.scale_factor(w, 640)
    d = _detections(spark, sf_dir).where("bbox is not null").select("frame_id", "det_no", w.alias("w"), h.alias("h"), f.alias("f"))
    return d.select("frame_id", "det_no", F.round("f", 6).alias("factor"), (F.col("h") * F.col("f")).cast("int").alias("new_height"))


def e22_scale_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.scale_back(F.col("bbox"), F.lit(1.7))
    return _polygons(spark, sf_dir).where("size(bbox) = 4").select("block_id", p.alias("p")).select("block_id", *[F.col("p")[i][j].alias(f"{n}{i + 1}") for i in range(4) for j, n in enumerate("xy")], G.bounding_rect(F.col("p")).alias("r")).select("*", "r.*").drop("r")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.col("bbox")
    rect = F.struct(box[0].alias("left"), box[1].alias("top"), (box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"))
    d = _detections(spark, sf_dir).where("bbox is not null").select("frame_id", "det_no", rect.alias("r"))
    d = d.select("frame_id", "det_no", G.region_above(F.col("r"), F.lit(_W), F.lit(_H)).alias("a"), G.region_below(F.col("r"), F.lit(_W), F.lit(_H)).alias("b"))
    return d.withColumn("m", G.merged_shape(F.col("a"), F.col("b")))


def e23_region_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("frame_id", "det_no", "a.*")


def e24_region_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("frame_id", "det_no", "b.*")


def e25_merged_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("frame_id", "det_no", "m.*")


def e14_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("bbox")[2] - F.col("bbox")[0]), (F.col("bbox")[3] - F.col("bbox")[1])
    return _detections(spark, sf_dir).where("bbox is not null").select("frame_id", "det_no", P.landscape_shape(w, h).alias("s")).select("frame_id", "det_no", "s.*")


def e15_half_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("rot_"), (F.pmod("det_no", F.lit(4)) * 90).cast("string"))
    return _detections(spark, sf_dir).groupBy(P.needs_half_turn(label, F.col("confidence"), 0.6).alias("turn")).agg(F.count("*").alias("n"))


def e10_mask_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(D.mask_value(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 6).alias("value"))


def d14_mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(D.coverage(D.binarize(F.col("embedding"), 0.1)), 6).alias("coverage"))


def e28_detection_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).where("class_name is not null and confidence is not null")
    return d.select("frame_id", "det_no", P.detection_label(F.col("class_name"), F.round(F.col("confidence"), 2)).alias("label"), P.palette_index(F.col("det_no"), 10).alias("colour"))


def e31_fit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("bbox")[2] - F.col("bbox")[0]), (F.col("bbox")[3] - F.col("bbox")[1])
    d = _detections(spark, sf_dir).where("bbox is not null").select("frame_id", "det_no", P.fit_scale(w, h, 230, 100).alias("s"))
    return d.select("frame_id", "det_no", F.round("s.scale", 6).alias("scale"), "s.width", "s.height")


QUERIES = {
    f.__name__: f
    for f in (
        c1_best_class, c4_candidates, c3_decode_inner, c3_decode_outer, c5_area_filter, w1_top_detections, w2_first_detection, w3_suppression, w3_dense_suppression, d9_bounding_rect, d10_extents, d8_polygon_area,
        d8_largest_polygon, w11_ordered_corners, e20_scale, e22_scale_back, e23_region_above, e24_region_below, e25_merged_shape, e14_landscape, e15_half_turn, e10_mask_value, d14_mask_coverage,
        e28_detection_label, e31_fit_scale,
    )
}

_D = "d AS (SELECT frame_id, det_no, class_name, confidence, bbox, bbox[3] - bbox[1] AS w, bbox[4] - bbox[2] AS h FROM detections_edge QUALIFY row_number() OVER (PARTITION BY frame_id, det_no ORDER BY synced_at DESC, class_name DESC NULLS LAST, confidence DESC NULLS LAST, bbox DESC NULLS LAST) = 1)"
_P = "p AS (SELECT DISTINCT block_id, bbox FROM ocr_blocks WHERE bbox IS NOT NULL)"
_DECODE = f"""WITH {_D}, c AS (SELECT frame_id, det_no, (bbox[1] + bbox[3]) / 2 AS xc, (bbox[2] + bbox[4]) / 2 AS yc, w, h FROM d WHERE bbox IS NOT NULL),
e AS (SELECT frame_id, det_no, trunc((xc - w / 2) * 1.5)::INT AS a, trunc((yc - h / 2) * 1.5)::INT AS b, trunc((xc + w / 2) * 1.5)::INT AS c, trunc((yc + h / 2) * 1.5)::INT AS d FROM c)"""
_IOU = """CASE WHEN k.bx IS NULL THEN 0 ELSE (greatest(0, least(k.bx[3], x.bx[3]) - greatest(k.bx[1], x.bx[1])) * greatest(0, least(k.bx[4], x.bx[4]) - greatest(k.bx[2], x.bx[2])))::DOUBLE /
  nullif((k.bx[3] - k.bx[1]) * (k.bx[4] - k.bx[2]) + (x.bx[3] - x.bx[1]) * (x.bx[4] - x.bx[2]) - greatest(0, least(k.bx[3], x.bx[3]) - greatest(k.bx[1], x.bx[1])) * greatest(0, least(k.bx[4], x.bx[4]) - greatest(k.bx[2], x.bx[2])), 0) END"""


def _nms_sql(rows: str, frame: str, ord_: str, threshold: float) -> str:
    fold = f"list_reduce(list_transform(l, lambda v: [v]), lambda acc, y: CASE WHEN len(list_filter(list_transform(acc, lambda k: [k, y[1]]), lambda z: over(z[1], z[2]) > {threshold})) > 0 THEN acc ELSE acc || y END)"
    over = _IOU.replace("k.bx", "p.bx").replace("x.bx", "q.bx")
    fold = fold.replace("over(z[1], z[2])", "coalesce(" + over.replace("p.bx", "z[1].bx").replace("q.bx", "z[2].bx") + ", 0)")
    return f"""WITH {_D}, s AS ({rows}), g AS (SELECT {frame}, list({{'o': {ord_}, 'bx': bbox}} ORDER BY confidence DESC, {ord_}) AS l FROM s GROUP BY 1),
k AS (SELECT {frame}, {fold} AS kept FROM g)
SELECT {frame}, kept[i].o AS {ord_}, i AS rank FROM k, unnest(range(1, len(kept) + 1)) AS t(i)"""


ORACLES = {
    "c1_best_class": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS class_id, round(list_max(embedding)::DOUBLE, 6) AS confidence FROM embeddings",
    "c4_candidates": "SELECT vec_id, i::INT AS i, round(embedding[i + 1]::DOUBLE, 6) AS x, round(embedding[16 + i + 1]::DOUBLE, 6) AS score FROM embeddings, unnest(range(0, 16)) AS t(i)",
    "c3_decode_inner": f"{_DECODE} SELECT frame_id, det_no, least(greatest(0, a), {_W - 1}) AS x1, least(greatest(0, b), {_H - 1}) AS y1, least(greatest(0, c), {_W}) AS x2, least(greatest(0, d), {_H}) AS y2 FROM e",
    "c3_decode_outer": f"{_DECODE} SELECT frame_id, det_no, greatest(0, a) AS x1, greatest(0, b) AS y1, least({_W}, c) AS x2, least({_H}, d) AS y2 FROM e",
    "c5_area_filter": f"WITH {_D} SELECT frame_id, det_no, w * h AS area FROM d WHERE confidence > 0.5 AND w * h <= {_W} * {_H} * 0.05",
    "w1_top_detections": f"WITH {_D} SELECT frame_id, det_no, (row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, det_no))::INT AS rank FROM d WHERE confidence IS NOT NULL QUALIFY rank <= 2",
    "w2_first_detection": f"WITH {_D} SELECT frame_id, det_no, class_name FROM d WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY confidence DESC, det_no) = 1",
    "w3_suppression": _nms_sql("SELECT * FROM d WHERE confidence > 0.5 AND bbox IS NOT NULL", "frame_id", "det_no", 0.3),
    "w3_dense_suppression": _nms_sql("SELECT substr(frame_id, 1, 25) AS dense, frame_id || '#' || det_no::VARCHAR AS ord, confidence, bbox FROM d WHERE confidence > 0.5 AND bbox IS NOT NULL", "dense", "ord", 0.45),
    "d9_bounding_rect": f"""WITH {_P}, q AS (SELECT block_id, list_transform(bbox, lambda v: v[1]) AS x, list_transform(bbox, lambda v: v[2]) AS y FROM p)
SELECT block_id, list_min(x) AS left, list_min(y) AS top, list_max(x) - list_min(x) AS width, list_max(y) - list_min(y) AS height FROM q""",
    "d10_extents": f"""WITH {_P}, q AS (SELECT block_id, list_transform(bbox, lambda v: v[1]) AS x, list_transform(bbox, lambda v: v[2]) AS y FROM p)
SELECT block_id, list_min(y) AS top, list_max(y) AS bottom, list_min(x) AS left, list_max(x) AS right, floor(list_sum(x) / 4)::BIGINT AS center_x, floor(list_sum(y) / 4)::BIGINT AS center_y FROM q""",
    "d8_polygon_area": f"""WITH {_P} SELECT block_id, abs(list_sum(list_transform(range(1, len(bbox) + 1), lambda i: bbox[i][1] * bbox[i % len(bbox) + 1][2] - bbox[i % len(bbox) + 1][1] * bbox[i][2]))) / 2 AS area FROM p""",
    "d8_largest_polygon": """WITH q AS (SELECT DISTINCT frame_id, bbox FROM ocr_blocks WHERE bbox IS NOT NULL)
SELECT frame_id, max(abs(list_sum(list_transform(range(1, len(bbox) + 1), lambda i: bbox[i][1] * bbox[i % len(bbox) + 1][2] - bbox[i % len(bbox) + 1][1] * bbox[i][2]))) / 2) AS area FROM q GROUP BY 1""",
    "w11_ordered_corners": f"""WITH {_P} SELECT block_id, bbox[1][1] AS x1, bbox[1][2] AS y1, bbox[2][1] AS x2, bbox[2][2] AS y2, bbox[3][1] AS x3, bbox[3][2] AS y3, bbox[4][1] AS x4, bbox[4][2] AS y4 FROM p WHERE len(bbox) = 4""",
    "e20_scale": f"""WITH {_D}, q AS (SELECT *, CASE WHEN abs(640 / nullif(w, 0) - 1) < 0.01 THEN 1.0 ELSE 640 / nullif(w, 0) END AS f FROM d WHERE bbox IS NOT NULL)
SELECT frame_id, det_no, round(f, 6) AS factor, trunc(h * f)::INT AS new_height FROM q""",
    "e22_scale_back": f"""WITH {_P} SELECT *, least(x1, x2, x3, x4) AS left, least(y1, y2, y3, y4) AS top, greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4) AS width, greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS height
FROM (SELECT block_id, {', '.join(f"trunc(bbox[{i}][{j}] / 1.7)::INT AS {n}{i}" for i in range(1, 5) for j, n in ((1, 'x'), (2, 'y')))} FROM p WHERE len(bbox) = 4)""",
    "e23_region_above": f"""WITH {_D}, q AS (SELECT frame_id, det_no, bbox[2] AS t, bbox[3] AS r FROM d WHERE bbox IS NOT NULL),
a AS (SELECT *, greatest(0, r - 336) AS x1, greatest(0, t - 194) AS y1, least({_W}, r + 336) AS x2, t AS y2 FROM q)
SELECT frame_id, det_no, CASE WHEN bad THEN greatest(0, r - 60) ELSE x1 END AS x1, CASE WHEN bad THEN greatest(0, t - 40) ELSE y1 END AS y1, CASE WHEN bad THEN least({_W}, r + 60) ELSE x2 END AS x2, y2 FROM (SELECT *, y1 >= y2 OR x1 >= x2 AS bad FROM a)""",
    "e24_region_below": f"""WITH {_D}, q AS (SELECT frame_id, det_no, bbox[2] AS t, bbox[1] AS l, bbox[2] + trunc(h * 0.4)::INT AS y1 FROM d WHERE bbox IS NOT NULL),
a AS (SELECT *, greatest(1, l - 5) AS x2, least({_H}, y1 + 594) AS y2 FROM q)
SELECT frame_id, det_no, 0 AS x1, CASE WHEN y1 >= y2 THEN t ELSE y1 END AS y1, CASE WHEN y1 >= y2 THEN greatest(1, l) ELSE x2 END AS x2, CASE WHEN y1 >= y2 THEN {_H} ELSE y2 END AS y2 FROM a""",
    "e14_landscape": f"WITH {_D} SELECT frame_id, det_no, greatest(w, h) AS width, least(w, h) AS height, h > w AS turned FROM d WHERE bbox IS NOT NULL",
    "e15_half_turn": f"WITH {_D} SELECT det_no % 4 = 2 AND coalesce(confidence > 0.6, false) AS turn, count(*) AS n FROM d GROUP BY 1",
    "e10_mask_value": "SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE * embedding[i + 32]::DOUBLE)))), 6) AS value FROM embeddings",
    "d14_mask_coverage": "SELECT vec_id, round(len(list_filter(embedding, lambda v: v > 0.1)) * 100.0 / len(embedding), 6) AS coverage FROM embeddings",
    "e28_detection_label": f"WITH {_D} SELECT frame_id, det_no, printf('%s: %.2f', class_name, round(confidence, 2)) AS label, det_no % 10 AS colour FROM d WHERE class_name IS NOT NULL AND confidence IS NOT NULL",
    "e31_fit_scale": f"""WITH {_D}, q AS (SELECT *, least(230 / w, 100 / h, 1.0) AS s FROM d WHERE bbox IS NOT NULL)
SELECT frame_id, det_no, round(s, 6) AS scale, trunc(w * s)::INT AS width, trunc(h * s)::INT AS height FROM q""",
}
ORACLES["e25_merged_shape"] = f"""WITH a AS ({ORACLES['e23_region_above']}), b AS ({ORACLES['e24_region_below']})
SELECT frame_id, det_no, greatest((a.x2 - a.x1) * 2, b.x2 - b.x1) AS width, (a.y2 - a.y1) * 2 + 3 + b.y2 - b.y1 AS height FROM a JOIN b USING (frame_id, det_no)"""
