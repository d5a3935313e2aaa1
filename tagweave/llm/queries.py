"""Queries of the data-preparation operators, over whole tables with production parameters, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.canonical import canonical_entries
from tagweave.llm.codes import canonical_code
from tagweave.llm.leakage import leaks
from tagweave.llm.packing import fill, pack, token_count
from tagweave.llm.reading import reading_levels
from tagweave.llm.runs import collapse_runs
from tagweave.llm.survivors import FieldRule, best_records, field_survivors
from tagweave.runtime import cut_lineage, is_blank, table


def _coded(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with ``value`` and ``complete`` of the canonical code; a generator, so that the code is worked out once a row."""
    return rows.select(*columns, F.inline(F.array(canonical_code(F.col("label_data.full_order_code")))))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _coded(table(spark, sf_dir, "results"), "camera_id", "frame_id", "captured_at")
    return collapse_runs(frames, F.col("camera_id"), F.col("frame_id"), F.col("captured_at"), F.col("value"), F.col("complete"), shape_only=True)


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumnsRenamed({"entity": "camera_id", "value": "full_order_code", "first_id": "first_frame_id", "last_id": "last_frame_id"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).where("n_events >= 2").select(F.col("first_id").alias("first_frame_id"), F.col("last_id").alias("last_frame_id"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label_data")
    fields = [label[c].alias(c) for c in ("date_code", "product_code", "size", "color", "is_valid", "field_confidences")]
    return table(spark, sf_dir, "label_records").select("record_id", "backend", "processed_at", *fields, canonical_code(label.full_order_code).value.alias("value"))


def _trust(key: str) -> tuple:
    return (F.coalesce(F.col("is_valid"), F.lit(False)), F.col("field_confidences")[key], F.col("processed_at"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "product": FieldRule(F.col("product_code"), _trust("productCode")),
        "size": FieldRule(F.col("size"), _trust("size")),
    }
    found = field_survivors(_labels(spark, sf_dir), F.col("value"), F.col("record_id"), rules)
    return found.select(F.col("group_key").alias("full_order_code"), "product_record_id", "size_record_id")


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = best_records(
        _labels(spark, sf_dir),
        F.col("value"),
        F.col("record_id"),
        [F.col(c) for c in ("date_code", "product_code", "size", "color")],
        (F.coalesce(F.col("is_valid"), F.lit(False)), F.col("processed_at")),
        {c: F.col(c) for c in ("backend", "product_code", "size", "color")},
    )
    return best.withColumnRenamed("group_key", "full_order_code")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t, c, n: table(spark, sf_dir, t).select(F.lit(n).alias("list_name"), F.col(c).alias("entry"))
    return of("products", "code", "product").unionByName(of("sizes", "name", "size")).unionByName(of("colors", "name", "color"))


def _free_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_id, list_name, raw_value``: every value of the texts and results that isn't an entry as it stands, once a frame."""
    read = table(spark, sf_dir, "ocr_blocks").where(F.col("zone").isin("product", "size", "color")).select("frame_id", F.col("zone").alias("list_name"), F.col("text").alias("raw_value"))
    label = F.col("label_data")
    fields = F.array(*[F.struct(F.lit(n).alias("list_name"), c.alias("raw_value")) for n, c in (("product", label.product_code), ("size", label["size"]), ("color", label.color))])
    results = table(spark, sf_dir, "results").select("frame_id", F.explode(fields).alias("x")).select("frame_id", "x.*")
    both = read.unionByName(results).where(~is_blank(F.col("raw_value")) & F.col("frame_id").isNotNull())
    free = both.join(_lists(spark, sf_dir).withColumnRenamed("entry", "raw_value"), ["list_name", "raw_value"], "left_anti")
    # A small part of the rows, read twice: for its distinct values, and to give each frame its entry.
    return cut_lineage(free.select("frame_id", "list_name", "raw_value").distinct())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = _free_values(spark, sf_dir)
    mapped = canonical_entries(free, _lists(spark, sf_dir))
    return free.join(mapped, ["list_name", "raw_value"]).select("frame_id", "list_name", "raw_value", "entry")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = _free_values(spark, sf_dir)
    mapped = canonical_entries(free, _lists(spark, sf_dir)).where("entry = '(none)'")
    return free.groupBy("list_name", "raw_value").agg(F.count("*").alias("n_frames")).join(mapped, ["list_name", "raw_value"]).select("list_name", "raw_value", "n_frames")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), F.col("doc_id"), token_count(F.col("text")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).where("is_split and piece = 1").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _packed(spark, sf_dir).groupBy("container").agg(F.sum("piece_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    return by.withColumn("unused", 1024 - F.col("n_tokens"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(_packed(spark, sf_dir))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any right filling must show: all tokens and pieces there, nothing over capacity or split without need, hardly more
    containers than the bound that no filling beats."""
    split = F.count_if((F.col("n_tokens") <= 1024) & (F.col("piece_tokens") < F.col("n_tokens")))
    by = _packed(spark, sf_dir).groupBy("container").agg(F.sum("piece_tokens").alias("t"), F.count("*").alias("k"), F.count_if(F.col("piece") == 1).alias("d"), split.alias("s"))
    total = by.agg(F.count("*").alias("n"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.count_if(F.col("t") > 1024).alias("n_overfull"), F.sum("s").alias("n_split_without_need"), F.sum("d").alias("n_documents"))
    least = F.ceil(F.col("n_tokens") / 1024)
    return total.select("n_pieces", "n_tokens", least.alias("least_containers"), (F.col("n") <= F.ceil(least * 1.01)).alias("tight"), "n_overfull", "n_split_without_need", "n_documents")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), table(spark, sf_dir, "eval_items"), F.col("item_id"), F.col("text"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaked = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, sf_dir, "eval_items").select("item_id", "topic").join(leaked, "item_id", "left").select("item_id", "topic", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "level_labels")
    return reading_levels(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), F.col("lang"), labels, F.col("doc_id"), F.col("band"), F.col("rater")).where("is_english and n_words >= 25")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "band")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return levels.groupBy("source", "band").agg(F.count("*").alias("n_documents"), F.round(F.avg("level"), 2).alias("mean_level"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p4_found, p4_survivors, p5_found, p5_unmatched, p6_found, p6_containers, p6_fill, p6_totals, p7_found, p7_items, p8_found, p8_profile)}

# The printed code that a noisy reading stands for, as a SQL expression over the column c.
_CODE = r"""
codes AS (SELECT *, regexp_replace(upper(regexp_replace(c, '^[^A-Za-z0-9_]*([A-Za-z .]{1,12}[:=#]|\][A-Za-z][0-9])\s*', '')), '[^A-Z0-9|/]', '', 'g') AS u FROM raw
  WHERE c IS NOT NULL AND NOT regexp_full_match(c, '\s*')),
halves AS (SELECT *, split_part(u, '/', 1) AS b, translate(split_part(u, '/', 2), 'OQDIL|ZSBG', '0001112586') AS r FROM codes),
pieces AS (SELECT *, [translate(substr(b, 1, 6), 'OQDIL|ZSBG', '0001112586'), translate(substr(b, 7, 2), '012568|', 'OIZSGBI'), translate(substr(b, 9, 1), '012568|', 'OIZSGBI'),
    translate(substr(b, 10, 8), 'OQDIL|ZSBG', '0001112586'), translate(substr(b, 18), 'OQDIL|ZSBG', '0001112586')] AS p FROM halves),
coded AS (SELECT *, array_to_string(list_filter(p, lambda x: x <> ''), '-') || CASE WHEN r NOT IN ('', '0') THEN '/' || r ELSE '' END AS code FROM pieces)"""

_RUNS = rf"""WITH raw AS (SELECT camera_id, frame_id, min(captured_at) AS t, min(label_data.full_order_code) AS c FROM results WHERE camera_id IS NOT NULL AND captured_at IS NOT NULL
  AND NOT regexp_full_match(label_data.full_order_code, '\s*') GROUP BY ALL), {_CODE},
w AS (SELECT *, CASE WHEN regexp_full_match(code, '\d{{6}}-[A-Z]{{2}}-[A-Z]-\d{{8}}-\d+(/\d+)?') THEN code END AS k FROM coded),
x AS (SELECT *, coalesce(k, CASE WHEN a = z AND starts_with(a, code) THEN a END, code) AS v FROM (
  SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY t, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
    first_value(k IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY t, frame_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM w)),
y AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER q OR t - lag(t) OVER q > INTERVAL 60 SECOND THEN 1 ELSE 0 END AS s FROM x WINDOW q AS (PARTITION BY camera_id ORDER BY t, frame_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY camera_id ORDER BY t, frame_id) AS run FROM y)"""

ORACLES = {
    "p6_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+')) > 1024",
    "p6_totals": r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+'))::BIGINT AS n FROM documents)
SELECT sum(ceil(n / 1024))::BIGINT AS n_pieces, sum(n)::BIGINT AS n_tokens, ceil(sum(n) / 1024)::BIGINT AS least_containers, true AS tight, 0::BIGINT AS n_overfull, 0::BIGINT AS n_split_without_need, count(*) AS n_documents FROM n WHERE n > 0""",
    "p1_found": rf"""{_RUNS}
SELECT arg_min(frame_id, (t, frame_id)) AS first_frame_id, arg_max(frame_id, (t, frame_id)) AS last_frame_id FROM g GROUP BY camera_id, run HAVING count(*) > 1""",
    "p1_runs": rf"""{_RUNS}
SELECT camera_id, any_value(v) AS full_order_code, arg_min(frame_id, (t, frame_id)) AS first_frame_id, arg_max(frame_id, (t, frame_id)) AS last_frame_id, min(t) AS first_ts, max(t) AS last_ts, count(*) AS n_events,
  (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS duration_s FROM g GROUP BY camera_id, run""",
    "p4_survivors": rf"""WITH raw AS (SELECT *, label_data.full_order_code AS c FROM label_records), {_CODE},
f AS (SELECT *, (coalesce(trim(label_data.date_code), '') <> '')::INT + (coalesce(trim(label_data.product_code), '') <> '')::INT + (coalesce(trim(label_data.size), '') <> '')::INT + (coalesce(trim(label_data.color), '') <> '')::INT AS n_filled FROM coded)
SELECT code AS full_order_code, record_id, n_filled, backend, label_data.product_code AS product_code, label_data.size AS size, label_data.color AS color FROM f
QUALIFY row_number() OVER (PARTITION BY code ORDER BY n_filled DESC, coalesce(label_data.is_valid, false) DESC, processed_at DESC NULLS LAST, record_id DESC) = 1""",
    "p4_found": rf"""WITH raw AS (SELECT *, label_data.full_order_code AS c FROM label_records), {_CODE},
n AS (SELECT code FROM coded GROUP BY 1 HAVING count(DISTINCT record_id) > 1),
p AS (SELECT code, record_id FROM coded WHERE trim(label_data.product_code) <> '' QUALIFY row_number() OVER (PARTITION BY code ORDER BY coalesce(label_data.is_valid, false) DESC,
  label_data.field_confidences['productCode'] DESC NULLS LAST, processed_at DESC NULLS LAST, record_id DESC) = 1),
s AS (SELECT code, record_id FROM coded WHERE trim(label_data.size) <> '' QUALIFY row_number() OVER (PARTITION BY code ORDER BY coalesce(label_data.is_valid, false) DESC,
  label_data.field_confidences['size'] DESC NULLS LAST, processed_at DESC NULLS LAST, record_id DESC) = 1)
SELECT n.code AS full_order_code, p.record_id AS product_record_id, s.record_id AS size_record_id FROM n LEFT JOIN p USING (code) LEFT JOIN s USING (code)""",
}
