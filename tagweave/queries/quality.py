"""Queries of the core's data-quality operators (profiles by load, differences between copies) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators import profile as P
from tagweave.operators.reconcile import Field, close_to, reconcile
from tagweave.runtime import cut_lineage, table

# The usual forms, told on masks.
FORMS = {
    "product_code": P.Form("^[Aa9]{3,9}$"),
    "size": P.Form("^[A9/-]{1,7}$"),
    "color": P.Form("^[Aa /]{3,}$"),
    "date_code": P.Form("^9{6}$", "MMddyy"),
}


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {c: F.col(f"label_data.{c}") for c in FORMS}
    # The counts are far fewer than the rows and are read several times, so they are written once instead of counted again.
    return cut_lineage(P.value_counts(table(spark, sf_dir, "results"), F.col("load_id"), cols, {"date_code": P.code_date(cols["date_code"])}, F.col("captured_at")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.findings(P.profile(_counts(spark, sf_dir), FORMS), with_mix=("product_code", "size", "color"), with_range=("date_code",))
    return found.select(F.col("load").alias("load_id"), "column_name", "finding")


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.profile(_counts(spark, sf_dir), FORMS)
    return p.select(
        F.col("load").alias("load_id"), "column_name", "n_rows", "n_present", "n_distinct", "min_value", "max_value", "min_length", "max_length", "n_malformed", "n_far", "dominant_mask", "dominant_n"
    )


def p2_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rare_masks(_counts(spark, sf_dir)).select("column_name", "mask", "n", "n_values", "example", "is_rare")


def p2_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drift_between(_counts(spark, sf_dir)).withColumnRenamed("load", "load_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = r"^\s+|\s+$"
    return reconcile(
        table(spark, sf_dir, "detections_edge"),
        table(spark, sf_dir, "detections_hub"),
        {"frame_id": F.lower(F.regexp_replace("frame_id", outer, "")), "det_no": F.col("det_no")},
        F.col("synced_at"),
        {
            "confidence": close_to(F.col("confidence"), 0.001),
            "bbox": Field(F.col("bbox")),
            "class_name": Field(F.lower(F.regexp_replace("class_name", outer, ""))),
        },
        ("edge", "hub"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_masks, p2_drift, p3_found)}

_LONG = r"""
long AS (
  SELECT load_id, captured_at, c.column_name, CASE WHEN trim(c.v, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN NULL ELSE c.v END AS v
  FROM results, unnest([
    {'column_name': 'product_code', 'v': label_data.product_code}, {'column_name': 'size', 'v': label_data.size},
    {'column_name': 'color', 'v': label_data.color}, {'column_name': 'date_code', 'v': label_data.date_code}]) AS t(c)
),
cells AS (
  SELECT *, CASE WHEN column_name = 'date_code' AND regexp_full_match(v, '[0-9]{6}')
                 THEN try_cast('20' || substr(v, 5, 2) || '-' || substr(v, 1, 2) || '-' || substr(v, 3, 2) AS DATE) END AS d
  FROM long
),
marked AS (
  SELECT *, CASE column_name
      WHEN 'product_code' THEN NOT regexp_full_match(v, '[A-Za-z0-9]{3,9}') WHEN 'size' THEN NOT regexp_full_match(v, '[A-Z0-9/-]{1,7}')
      WHEN 'color' THEN NOT regexp_full_match(v, '[A-Za-z /]{3,}') ELSE v IS NOT NULL AND d IS NULL END AS bad,
    coalesce(captured_at::DATE < d - INTERVAL 24 MONTH OR captured_at::DATE > d + INTERVAL 24 MONTH, false) AS far,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'AA+', 'A+', 'g'), 'aa+', 'a+', 'g'), '99+', '9+', 'g'), 'üü+', 'ü+', 'g'), 'ÜÜ+', 'Ü+', 'g') AS m
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      v, '[A-Z]', chr(1), 'g'), '[a-z]', chr(2), 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]', 'ü', 'g'), '\p{Lu}', 'Ü', 'g'), chr(1), 'A', 'g'), chr(2), 'a', 'g'), '[0-9]', '9', 'g') AS w FROM cells)
)"""

_PER = _LONG + """,
per AS (
  SELECT load_id, column_name, count(*) AS n_rows, count(v) AS n_present, count(DISTINCT v) AS n_distinct, min(v) AS min_value, max(v) AS max_value,
    min(length(v))::INT AS min_length, max(length(v))::INT AS max_length, count(*) FILTER (WHERE bad) AS n_malformed, count(*) FILTER (WHERE far) AS n_far
  FROM marked GROUP BY ALL
)"""

ORACLES = {
    "p2_found": f"""WITH {_PER},
vc AS (SELECT load_id, column_name, v, count(*) AS n FROM marked WHERE v IS NOT NULL GROUP BY ALL),
al AS (SELECT column_name, v, sum(n) AS a FROM vc GROUP BY ALL),
tot AS (SELECT column_name, sum(a) AS t FROM al GROUP BY ALL)
SELECT load_id, column_name, 'nulls' AS finding FROM per WHERE (n_rows - n_present) * 100 >= 15 * n_rows
UNION ALL SELECT load_id, column_name, 'pattern' FROM per WHERE n_present > 0 AND n_malformed * 100 >= 15 * n_present
UNION ALL SELECT load_id, column_name, 'range' FROM per WHERE column_name = 'date_code' AND n_present > 0 AND n_far * 100 >= 15 * n_present
UNION ALL SELECT DISTINCT vc.load_id, vc.column_name, 'mix' FROM vc JOIN al USING (column_name, v) JOIN tot USING (column_name)
  JOIN per ON per.load_id = vc.load_id AND per.column_name = vc.column_name
  WHERE vc.column_name <> 'date_code' AND 10 * (n * t - a * n_present) >= 4 * n_present * t""",
    "p2_profile": f"""WITH {_PER},
mm AS (SELECT load_id, column_name, m, count(*) AS n FROM marked WHERE v IS NOT NULL GROUP BY ALL),
top AS (SELECT load_id, column_name, m AS dominant_mask, n AS dominant_n FROM mm QUALIFY row_number() OVER (PARTITION BY load_id, column_name ORDER BY n DESC, m DESC) = 1)
SELECT per.*, dominant_mask, dominant_n FROM per LEFT JOIN top USING (load_id, column_name)""",
    "p2_masks": f"""WITH {_LONG},
mm AS (SELECT column_name, m AS mask, count(*) AS n, count(DISTINCT v) AS n_values, min(v) AS example FROM marked WHERE v IS NOT NULL GROUP BY ALL)
SELECT *, n < 0.005 * sum(n) OVER (PARTITION BY column_name) AS is_rare FROM mm""",
    "p2_drift": f"""WITH {_LONG},
mm AS (SELECT load_id, column_name, m, count(*) AS n FROM marked WHERE v IS NOT NULL AND load_id IS NOT NULL GROUP BY ALL),
loads AS (SELECT *, lag(load_id) OVER (PARTITION BY column_name ORDER BY load_id) AS previous_load FROM (SELECT column_name, load_id, sum(n) AS ln FROM mm GROUP BY ALL)),
sh AS (SELECT column_name, load_id, previous_load, m, n / ln AS p FROM mm JOIN loads USING (column_name, load_id)),
pq AS (SELECT column_name, load_id, m, sum(p) AS p, sum(q) AS q FROM (
  SELECT column_name, load_id, m, p, 0.0 AS q FROM sh WHERE previous_load IS NOT NULL
  UNION ALL SELECT l.column_name, l.load_id, m, 0.0, p FROM loads l JOIN sh ON sh.column_name = l.column_name AND sh.load_id = l.previous_load) GROUP BY ALL)
SELECT load_id, previous_load, column_name, round(sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS divergence
FROM pq JOIN loads USING (column_name, load_id) GROUP BY ALL""",
    "p3_found": """WITH e0 AS (SELECT lower(trim(frame_id)) AS f, det_no AS d, * FROM detections_edge), h0 AS (SELECT lower(trim(frame_id)) AS f, det_no AS d, * FROM detections_hub),
e AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY f, d ORDER BY synced_at DESC NULLS LAST, confidence DESC NULLS LAST, bbox DESC NULLS LAST) = 1),
h AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY f, d ORDER BY synced_at DESC NULLS LAST, confidence DESC NULLS LAST, bbox DESC NULLS LAST) = 1),
j AS (SELECT e.f AS ef, h.f AS hf, coalesce(e.f, h.f) AS frame_id, coalesce(e.d, h.d) AS det_no, e.confidence AS ec, h.confidence AS hc, e.bbox AS eb, h.bbox AS hb,
  lower(trim(e.class_name)) AS en, lower(trim(h.class_name)) AS hn FROM e FULL JOIN h ON e.f = h.f AND e.d = h.d)
SELECT frame_id, det_no, 'only_edge' AS finding FROM j WHERE hf IS NULL
UNION ALL SELECT frame_id, det_no, 'only_hub' FROM j WHERE ef IS NULL
UNION ALL SELECT frame_id, det_no, 'confidence' FROM j WHERE ef IS NOT NULL AND hf IS NOT NULL AND ((ec IS NULL) <> (hc IS NULL) OR abs(ec - hc) > 0.001)
UNION ALL SELECT frame_id, det_no, 'bbox' FROM j WHERE ef IS NOT NULL AND hf IS NOT NULL AND eb IS DISTINCT FROM hb
UNION ALL SELECT frame_id, det_no, 'class_name' FROM j WHERE ef IS NOT NULL AND hf IS NOT NULL AND en IS DISTINCT FROM hn""",
}
