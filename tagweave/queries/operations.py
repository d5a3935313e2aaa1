"""Queries of the timing, triage, sampling and pipeline operators with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import patterns as P
from tagweave.functions.codes import CODE_PATTERN
from tagweave.operators import metrics as M
from tagweave.operators.cooldown import cooldown_samples
from tagweave.plans.pipeline import STAGE_ERRORS, reached_stage
from tagweave.runtime import is_blank, table
from tagweave.sources.sinks import frame_timing, record_of, stage_record


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivered frame with the outcome of its stages: what was read tells how far it came."""
    label = F.col("label_data")
    code = F.regexp_replace(label.full_order_code, r"^\s+|\s+$", "")
    return table(spark, sf_dir, "results").select(
        "frame_id", "camera_id", "load_id", "captured_at", "processing_time_ms",
        # A frame without any field of the label was not detected, one without texts lost its crop, one with texts of no zone its regions.
        (~(is_blank(label.full_order_code) & is_blank(label.product_code) & is_blank(label["size"]))).alias("detected"), (~(is_blank(label.full_order_code) & is_blank(label["size"]))).alias("preprocessed"),
        (~is_blank(label.color)).alias("regions"), (~is_blank(label.full_order_code)).alias("decoded"), F.coalesce(code.rlike(CODE_PATTERN), F.lit(False)).alias("parsed"),
        (~is_blank(label.position_quantity)).alias("read"),
    )


def _error() -> Column:
    """First failing stage's label. A code that doesn't parse fails the postprocessing, as does a missing position."""
    checks = (("detected", "s2"), ("preprocessed", "s3"), ("decoded", "s5"), ("regions", "s6"), ("parsed", "s8"), ("read", "s8"))
    return M.first_failing_stage([(F.col(c), STAGE_ERRORS[s]) for c, s in checks])


def _timing() -> Column:
    return F.when(F.col("decoded"), F.create_map(F.lit("total"), F.coalesce("processing_time_ms", F.lit(0.0)), F.lit("s8_postprocessing"), F.col("processing_time_ms") * 0.25))


def c9_stage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("frame_id", "load_id", _error().alias("error"))


def c10_code_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).where(_error() == STAGE_ERRORS["s5"]).select("frame_id", "load_id")


def d1_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.batch_summary(_frames(spark, sf_dir), [F.col("load_id")], _error().isNull(), _timing())
    return out.withColumns({c: F.round(c, 4) for c in ("avg_ms", "min_ms", "max_ms")})


def d3_stage_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stage_averages(_frames(spark, sf_dir), _timing()).withColumn("avg_ms", F.round("avg_ms", 6))


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency_stats(table(spark, sf_dir, "label_records").where("backend is not null"), ["backend"], "processing_time_ms")


def d5_backend_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latency(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("mean_ms", "median_ms", "min_ms", "max_ms", "std_ms")})


def d6_backend_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.compare_backends(_latency(spark, sf_dir), "backend", "wechat", "zxing")
    return out.select("base", "other", *[F.round(c, 6).alias(c) for c in ("base_ms", "other_ms", "difference_ms", "gain_percent")], "faster")


def d7_error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.error_triage(_frames(spark, sf_dir), "load_id", _error(), STAGE_ERRORS["s5"])


def d7_error_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.error_frames(_frames(spark, sf_dir), "load_id", "frame_id", _error(), STAGE_ERRORS["s5"])


def j4_error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    there, missing = M.error_files(_frames(spark, sf_dir), "frame_id", _error(), STAGE_ERRORS["s5"], table(spark, sf_dir, "detections_edge"), "frame_id")
    return there.select("frame_id", F.lit(True).alias("has_file")).unionByName(missing.select("frame_id", F.lit(False).alias("has_file")))


def d11_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).groupBy("load_id").agg(F.when(F.bool_or(_error().isNull()), 0).otherwise(1).alias("exit_status"))


def d12_accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda t: table(spark, sf_dir, t).where("class_name is not null and confidence between 0 and 1").groupBy(F.lower(F.trim("class_name")).alias("class_name")).agg(F.avg("confidence").alias(t))
    both = mean("detections_edge").join(mean("detections_hub"), "class_name")
    gap = F.col("detections_hub") - F.col("detections_edge")
    boxes = lambda t: table(spark, sf_dir, t).where("class_name is not null").groupBy(F.lower(F.trim("class_name")).alias("class_name")).agg((F.count_if("has_mask") / F.count("*")).alias(f"{t}_mask"))
    both = both.join(boxes("detections_edge"), "class_name").join(boxes("detections_hub"), "class_name")
    mask_gap = F.col("detections_hub_mask") - F.col("detections_edge_mask")
    return both.select("class_name", F.round(gap, 6).alias("difference"), F.round(gap / F.col("detections_edge"), 6).alias("relative"), M.metric_verdict(gap / F.col("detections_edge")).alias("verdict"), M.generalization_verdict(gap, mask_gap).alias("generalization"))


def w5_rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "results").where("processing_time_ms is not null").groupBy("camera_id", "frame_id").agg(F.min("captured_at").alias("captured_at"), F.round(F.min("processing_time_ms") * 10000).cast("long").alias("ms"))
    out = M.rolling_mean(rows, "camera_id", F.date_trunc("hour", "captured_at"), ["captured_at", "frame_id"], "ms", 200)
    return out.select("frame_id", "n", (F.col("rolling_mean") / 10000).alias("rolling_mean"))


def t2_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooldown_samples(_frames(spark, sf_dir), "camera_id", "frame_id", "captured_at", F.col("parsed"), 2.0).select("camera_id", "frame_id", "completed")


def t7_timed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).where(reached_stage(_error()) >= 5).groupBy("camera_id").agg(F.count("*").alias("n_timed"))


def b7_frame_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.create_map(F.lit("s7_ocr"), F.round("processing_time_ms", 4), F.lit("s8_postprocessing"), F.round("processing_time_ms", 4) + 1)
    record = frame_timing(F.col("frame_id"), F.col("captured_at"), steps)
    return table(spark, sf_dir, "results").select(record.alias("t")).select("t.frameId", F.col("t.timing_ms")["s7_ocr"].alias("ocr_ms"), F.round("t.summary.total_ms", 4).alias("total_ms"), "t.summary.fps")


def b4_detection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "detections_edge").select("frame_id", "det_no", "class_name", "bbox", "has_mask").distinct()
    one = F.struct("det_no", F.col("class_name").alias("className"), "bbox", F.col("has_mask").alias("hasMask"))
    frames = d.groupBy("frame_id").agg(F.sort_array(F.collect_list(one)).alias("x"))
    found = F.transform("x", lambda v: F.struct(v["className"].alias("className"), v["bbox"].alias("bbox"), v["hasMask"].alias("hasMask")))
    return frames.select("frame_id", stage_record("s2", F.col("frame_id"), numDetections=F.size("x"), detections=found).alias("record"))


def b5_result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "results")
    label = F.col("label_data")
    data = F.struct(label.full_order_code.alias("fullOrderCode"), label.qr_position.alias("qrPosition"), label["size"].alias("size"), label.is_valid.alias("isValid"))
    return r.select("frame_id", record_of("s8", F.col("frame_id"), label_data=data, processing_time_ms=F.round("processing_time_ms").cast("bigint")).alias("record")).distinct()


def b5_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "ocr_blocks").select("frame_id", F.struct("block_id", "text", "zone").alias("b")).distinct()
    blocks = b.groupBy("frame_id").agg(F.array_sort(F.collect_list("b")).alias("x"))
    texts = F.transform("x", lambda v: F.struct(v["text"].alias("text"), v["zone"].alias("zone")))
    return blocks.select("frame_id", record_of("s7", F.col("frame_id"), text_blocks=texts).alias("record"))


def b11_capture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.capture_name(F.col("ts")).alias("name"))


def e30_stage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(P.stage_key(F.col("event_type")).alias("stage")).agg(F.count("*").alias("n"))


def w7_first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The limit after the sort is the feature: the first hundred by source.
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(100)


def w10_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [table(spark, sf_dir, t).select(F.lower(F.trim("frame_id")).alias("frame_id")) for t in ("detections_edge", "detections_hub", "ocr_blocks")]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        c9_stage_errors, c10_code_errors, d1_batch_summary, d3_stage_averages, d5_backend_latency, d6_backend_comparison, d7_error_triage, d7_error_frames, j4_error_files, d11_batch_status, d12_accuracy_table,
        w5_rolling_rate, t2_cooldown, t7_timed_frames, b7_frame_timing, b4_detection_records, b5_result_records, b5_text_records, b11_capture_names, e30_stage_keys, w7_first_documents, w10_union_distinct,
    )
}

_F = r"""f AS (SELECT frame_id, camera_id, load_id, captured_at, processing_time_ms AS ms, coalesce(regexp_full_match(label_data.full_order_code, '\s*'), true) AS nocode,
  coalesce(regexp_full_match(label_data.product_code, '\s*'), true) AS noproduct, coalesce(regexp_full_match(label_data.size, '\s*'), true) AS nosize, coalesce(regexp_full_match(label_data.color, '\s*'), true) AS nocolor,
  coalesce(regexp_full_match(label_data.position_quantity, '\s*'), true) AS noposition,
  coalesce(regexp_full_match(label_data.full_order_code, '\s*\d{6}-[A-Z]{2}-[A-Z]-\d+-\d+(/\d+)?\s*'), false) AS parsed FROM results),
e AS (SELECT *, CASE WHEN nocode AND nosize AND noproduct THEN 'No label detected' WHEN nocode AND nosize THEN 'Preprocessing failed' WHEN nocode THEN 'No QR code detected' WHEN nocolor THEN 'Component extraction failed'
  WHEN NOT parsed OR noposition THEN 'Postprocessing failed' END AS error FROM f),
g AS (SELECT *, coalesce(error = 'No QR code detected', false) AS undecoded FROM e)"""

ORACLES = {
    "c9_stage_errors": f"WITH {_F} SELECT frame_id, load_id, error FROM g",
    "c10_code_errors": f"WITH {_F} SELECT frame_id, load_id FROM g WHERE undecoded",
    "d1_batch_summary": f"""WITH {_F} SELECT load_id, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS successful, count(error) AS failed, round(100.0 * count(*) FILTER (WHERE error IS NULL) / count(*), 2) AS success_rate,
  round(coalesce(avg(coalesce(ms, 0)) FILTER (WHERE NOT nocode), 0), 4) AS avg_ms, round(coalesce(min(coalesce(ms, 0)) FILTER (WHERE NOT nocode), 0), 4) AS min_ms, round(coalesce(max(coalesce(ms, 0)) FILTER (WHERE NOT nocode), 0), 4) AS max_ms,
  coalesce(CASE WHEN avg(coalesce(ms, 0)) FILTER (WHERE NOT nocode) > 0 THEN round(1000 / avg(coalesce(ms, 0)) FILTER (WHERE NOT nocode), 2) END, 0) AS avg_fps FROM g GROUP BY 1""",
    "d3_stage_averages": f"""WITH {_F} SELECT 'total' AS stage, count(*) AS n, round(avg(coalesce(ms, 0)), 6) AS avg_ms FROM g WHERE NOT nocode
UNION ALL SELECT 's8_postprocessing', count(ms), round(avg(ms * 0.25), 6) FROM g WHERE NOT nocode AND ms IS NOT NULL""",
    "d5_backend_latency": """SELECT backend, count(processing_time_ms) AS n, round(avg(processing_time_ms), 6) AS mean_ms, round(quantile_cont(processing_time_ms, 0.5), 6) AS median_ms, round(min(processing_time_ms), 6) AS min_ms,
  round(max(processing_time_ms), 6) AS max_ms, round(stddev_pop(processing_time_ms), 6) AS std_ms FROM label_records WHERE backend IS NOT NULL GROUP BY 1""",
    "d6_backend_comparison": """WITH s AS (SELECT backend, avg(processing_time_ms) AS m FROM label_records GROUP BY 1), b AS (SELECT (SELECT m FROM s WHERE backend = 'wechat') AS w, (SELECT m FROM s WHERE backend = 'zxing') AS z)
SELECT 'wechat' AS base, 'zxing' AS other, round(w, 6) AS base_ms, round(z, 6) AS other_ms, round(abs(w - z), 6) AS difference_ms, round((w - z) / w * 100, 6) AS gain_percent, CASE WHEN w > z THEN 'zxing' ELSE 'wechat' END AS faster FROM b""",
    "d7_error_triage": f"WITH {_F} SELECT load_id, grouping(load_id) = 1 AS is_total, count(*) AS total, count(*) FILTER (WHERE undecoded) AS errors, round(100.0 * count(*) FILTER (WHERE undecoded) / count(*), 2) AS error_rate FROM g GROUP BY ROLLUP (load_id)",
    "d7_error_frames": f"WITH {_F} SELECT DISTINCT load_id, frame_id FROM g WHERE undecoded",
    "j4_error_files": f"WITH {_F} SELECT DISTINCT frame_id, frame_id IN (SELECT frame_id FROM detections_edge) AS has_file FROM g WHERE undecoded",
    "d11_batch_status": f"WITH {_F} SELECT load_id, CASE WHEN bool_or(error IS NULL) THEN 0 ELSE 1 END AS exit_status FROM g GROUP BY 1",
    "d12_accuracy_table": """WITH e AS (SELECT lower(trim(class_name)) AS c, avg(confidence) AS a FROM detections_edge WHERE class_name IS NOT NULL AND confidence BETWEEN 0 AND 1 GROUP BY 1),
h AS (SELECT lower(trim(class_name)) AS c, avg(confidence) AS b FROM detections_hub WHERE class_name IS NOT NULL AND confidence BETWEEN 0 AND 1 GROUP BY 1)
SELECT c AS class_name, round(b - a, 6) AS difference, round((b - a) / a, 6) AS relative, CASE WHEN abs((b - a) / a) < 0.02 THEN 'negligible' WHEN abs((b - a) / a) < 0.05 THEN 'acceptable' ELSE 'significant' END AS verdict,
  CASE WHEN abs(b - a) < 0.05 AND abs(n - m) < 0.05 THEN 'good' WHEN b - a < -0.1 OR n - m < -0.1 THEN 'overfit' ELSE 'moderate' END AS generalization FROM e JOIN h USING (c)
  JOIN (SELECT lower(trim(class_name)) AS c, count(*) FILTER (WHERE has_mask) / count(*) AS m FROM detections_edge WHERE class_name IS NOT NULL GROUP BY 1) USING (c)
  JOIN (SELECT lower(trim(class_name)) AS c, count(*) FILTER (WHERE has_mask) / count(*) AS n FROM detections_hub WHERE class_name IS NOT NULL GROUP BY 1) USING (c)""",
    "w5_rolling_rate": """WITH r AS (SELECT camera_id, frame_id, min(captured_at) AS t, round(min(processing_time_ms) * 10000)::BIGINT AS ms FROM results WHERE processing_time_ms IS NOT NULL GROUP BY ALL)
SELECT frame_id, row_number() OVER w AS n, avg(ms) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) / 10000 AS rolling_mean FROM r WINDOW w AS (PARTITION BY camera_id ORDER BY t, frame_id)""",
    "t2_cooldown": f"""WITH RECURSIVE {_F}, r AS (SELECT camera_id, frame_id, min(captured_at) AS t, bool_or(parsed) AS c FROM g WHERE camera_id IS NOT NULL GROUP BY ALL),
l AS (SELECT camera_id, list({{'f': frame_id, 't': epoch_us(t), 'c': c}} ORDER BY t, frame_id) AS x FROM r GROUP BY 1),
k AS (SELECT camera_id, x, list_reduce(list_transform(x, lambda v: {{'last': v.t, 'c': v.c, 'kept': [v.f], 'done': [v.c]}}), lambda a, v: CASE
    WHEN a.last IS NULL OR v.last - a.last >= 2000000 THEN {{'last': CASE WHEN v.c THEN v.last ELSE a.last END, 'c': v.c, 'kept': a.kept || v.kept, 'done': a.done || v.done}} ELSE a END,
    {{'last': NULL::BIGINT, 'c': false, 'kept': []::VARCHAR[], 'done': []::BOOLEAN[]}}) AS s FROM l)
SELECT camera_id, s.kept[i] AS frame_id, s.done[i] AS completed FROM k, unnest(range(1, len(s.kept) + 1)) AS t(i)""",
    "t7_timed_frames": f"WITH {_F} SELECT camera_id, count(*) AS n_timed FROM g WHERE error IS NULL OR error IN ('No QR code detected', 'Component extraction failed', 'Postprocessing failed') GROUP BY 1",
    "b7_frame_timing": """WITH r AS (SELECT frame_id, round(processing_time_ms, 4) AS a, round(processing_time_ms, 4) + 1 AS b FROM results), t AS (SELECT *, coalesce(a, 0) + coalesce(b, 0) AS total FROM r)
SELECT frame_id AS "frameId", a AS ocr_ms, round(total, 4) AS total_ms, CASE WHEN total > 0 THEN round(1000 / total, 2) ELSE 0 END AS fps FROM t""",
    "b4_detection_records": """WITH d AS (SELECT DISTINCT frame_id, det_no, class_name, bbox, has_mask FROM detections_edge)
SELECT frame_id, to_json({'frameId': frame_id, 'numDetections': count(*), 'detections': list({'className': class_name, 'bbox': bbox, 'hasMask': has_mask} ORDER BY det_no, class_name NULLS FIRST, bbox NULLS FIRST, has_mask NULLS FIRST)})::VARCHAR AS record FROM d GROUP BY 1""",
    "b5_result_records": """SELECT DISTINCT frame_id, to_json({'frameId': frame_id, 'labelData': CASE WHEN label_data IS NOT NULL THEN {'fullOrderCode': label_data.full_order_code, 'qrPosition': label_data.qr_position, 'size': label_data.size, 'isValid': label_data.is_valid} END,
  'processingTimeMs': round(processing_time_ms)::BIGINT})::VARCHAR AS record FROM results""",
    "b5_text_records": """WITH b AS (SELECT DISTINCT frame_id, block_id, text, zone FROM ocr_blocks)
SELECT frame_id, to_json({'frameId': frame_id, 'textBlocks': list({'text': text, 'zone': zone} ORDER BY block_id NULLS FIRST, text NULLS FIRST, zone NULLS FIRST)})::VARCHAR AS record FROM b GROUP BY 1""",
    "b11_capture_names": "SELECT event_id, strftime(ts, 'capture_%Y%m%d_%H%M%S_%f.png') AS name FROM events",
    "e30_stage_keys": "SELECT upper(split_part(event_type, '_', 1)) AS stage, count(*) AS n FROM events GROUP BY 1",
    "w7_first_documents": "SELECT doc_id, source FROM documents ORDER BY source NULLS FIRST, doc_id LIMIT 100",
    "w10_union_distinct": "SELECT lower(trim(frame_id)) AS frame_id FROM detections_edge UNION SELECT lower(trim(frame_id)) FROM detections_hub UNION SELECT lower(trim(frame_id)) FROM ocr_blocks",
}
