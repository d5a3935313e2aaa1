"""Queries of the label operators (codes, dictionaries, fields, display) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions import patterns as P
from tagweave.functions import similarity as S
from tagweave.functions.codes import parse_code
from tagweave.operators.dictionary import exact_match, fuzzy_match, load_entries
from tagweave.operators.fields import assign_fields, position_quantity
from tagweave.runtime import table
from tagweave.sources import config as C


def _codes(spark: SparkSession, sf_dir: str, strip: bool = True) -> DataFrame:
    r = table(spark, sf_dir, "results")
    return r.select("frame_id", "camera_id", "load_id", "captured_at", "processing_time_ms", "label_data", parse_code(F.col("label_data.full_order_code"), strip).alias("qr"))


def e1_code_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("frame_id", "load_id", "qr.*").withColumnRenamed("position", "qr_position")


def e1_code_parse_unstripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir, False).where("qr is not null").groupBy("qr.facility", "qr.order_type").agg(F.count("*").alias("n"), F.max("qr.position").alias("max_position"))


def d1_facility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce((F.col("qr.position") == F.col("label_data.ocr_position")) & (F.col("label_data.ocr_position") > 0), F.lit(False))
    return _codes(spark, sf_dir).where("qr is not null").groupBy("qr.facility").agg(F.count("*").alias("n_frames"), F.count_if(ok).alias("n_valid"))


def c12_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label_data")
    valid = F.coalesce((label.qr_position == label.ocr_position) & (label.ocr_position > 0), F.lit(False))
    return table(spark, sf_dir, "results").groupBy("camera_id", valid.alias("valid")).agg(F.count("*").alias("n"))


def c11_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "ocr_blocks").select(
        "block_id", P.is_product(t).alias("is_product"), P.is_size(t).alias("is_size"), P.is_color(t).alias("is_color"), P.is_position_quantity(t).alias("is_position_quantity")
    )


def a8_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, column, upper in (("products", "code", False), ("sizes", "name", True), ("colors", "name", True)):
        part = load_entries(table(spark, sf_dir, name), column, upper).select(F.lit(name).alias("list"), "entry")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ord", F.row_number().over(W.partitionBy("list").orderBy("entry")))


def _dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "product": load_entries(table(spark, sf_dir, "products"), "code", False),
        "size": load_entries(table(spark, sf_dir, "sizes"), "name", True),
        "color": load_entries(table(spark, sf_dir, "colors"), "name", True),
    }


def j1_exact_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dictionaries(spark, sf_dir)
    blocks = table(spark, sf_dir, "ocr_blocks").where("text is not null").select("text").distinct()
    found = exact_match(blocks, "text", d["product"], keep_case=True).withColumnRenamed("match", "product")
    found = exact_match(found, "text", d["size"]).withColumnRenamed("match", "size")
    return exact_match(found, "text", d["color"]).withColumnRenamed("match", "color")


def e4_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "label_records").select("frame_id", F.col("label_data.product_code").alias("a"))
    b = table(spark, sf_dir, "results").select("frame_id", F.col("label_data.product_code").alias("b"))
    pairs = a.join(b, "frame_id").where("a is not null and b is not null").select(S.folded(F.col("a")).alias("a"), S.folded(F.col("b")).alias("b")).distinct()
    x, y = F.col("a"), F.col("b")
    return pairs.select(
        "a", "b", F.levenshtein(x, y).alias("edits"), F.round(S.edit_similarity(x, y), 6).alias("edit_similarity"), F.round(S.jaro_winkler(x, y), 6).alias("jaro_winkler"), S.is_match(x, y).alias("is_match")
    )


def j2_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "ocr_blocks").where("zone = 'color' and text is not null").select("text").distinct()
    found = fuzzy_match(texts, "text", _dictionaries(spark, sf_dir)["color"], 0.9)
    return found.select("text", "match", F.round("score", 6).alias("score"))


def j2_fuzzy_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of any zone against all three dictionaries."""
    texts, out = table(spark, sf_dir, "ocr_blocks").where("text is not null").select("text").distinct(), None
    for name, entries in _dictionaries(spark, sf_dir).items():
        found = fuzzy_match(texts, "text", entries, 0.9).select("text", F.lit(name).alias("list"), "match", F.round("score", 6).alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a frame: the code's position, 0 where the code can't be read."""
    return _codes(spark, sf_dir).groupBy("frame_id").agg(F.coalesce(F.max("qr.position"), F.lit(0)).alias("qr_position"))


def e7_position_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "ocr_blocks").select("frame_id", "block_no", "text").join(_positions(spark, sf_dir), "frame_id")
    pq = position_quantity(F.col("text"), F.col("qr_position"))
    return blocks.select("frame_id", "block_no", "text", "qr_position", pq.alias("pq")).where("pq is not null").select("frame_id", "block_no", "text", "qr_position", "pq.position", "pq.quantity", "pq.factor").distinct()


def e9_field_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "ocr_blocks").select("frame_id", "block_id", "text", "confidence", F.get(F.get("bbox", F.lit(0)), F.lit(1)).alias("y"))
    frames = _positions(spark, sf_dir).join(blocks.select("frame_id").distinct(), "frame_id", "left_semi")
    return assign_fields(frames, "frame_id", "qr_position", blocks, "text", "confidence", "y", "block_id", _dictionaries(spark, sf_dir))


def e9_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assigned fields with their confidences as columns."""
    told = e9_field_assignment(spark, sf_dir)
    keys = {"position_conf": "positionQuantity", "product_conf": "productCode", "size_conf": "size", "color_conf": "color"}
    return told.select(*[c for c in told.columns if c != "field_confidences"], *[F.round(F.col("field_confidences")[k], 6).alias(c) for c, k in keys.items()])


def w4_blocks_top_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "ocr_blocks").where("bbox is not null and size(bbox) > 0").select("frame_id", F.struct(F.col("bbox")[0][1].alias("y"), "block_id", "text").alias("b")).distinct()
    ordered = blocks.groupBy("frame_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return ordered.select("frame_id", F.array_join(F.transform("b", lambda x: F.coalesce(x["text"], F.lit(""))), "|").alias("texts"))


def j3_code_with_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "ocr_blocks").groupBy("frame_id").agg(F.count_distinct("block_id").alias("n_blocks"))
    codes = _codes(spark, sf_dir).where("qr is not null").select("frame_id", "qr.order_number", "qr.position").distinct()
    return codes.join(texts, "frame_id")


def j6_zipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts and scores as two parallel arrays of a frame; the score array lacks the scores after its last known one.
    b = table(spark, sf_dir, "ocr_blocks").where("text is not null").select("frame_id", "block_id", "text", "confidence").distinct()
    arrays = b.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "text", "confidence"))).alias("x"))
    arrays = arrays.select("frame_id", F.transform("x", lambda v: v["text"]).alias("texts"), F.array_compact(F.transform("x", lambda v: v["confidence"])).alias("scores"))
    zipped = arrays.select("frame_id", F.posexplode(F.arrays_zip("texts", "scores")).alias("i", "z"))
    return zipped.where("z.texts is not null").select("frame_id", "i", F.col("z.texts").alias("text"), F.coalesce("z.scores", F.lit(0.0)).alias("score"))


def e29_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label_data")
    return table(spark, sf_dir, "results").select(
        "frame_id", P.order_display(label.order_type, label.order_number).alias("order_text"), P.or_dashes(label.qr_position).alias("position"), P.or_dashes(label["size"]).alias("size"), P.validity_display(label.is_valid).alias("validity")
    )


def a4_frame_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("camera_id", F.lit("_"), P.frame_id(F.col("captured_at")))
    return table(spark, sf_dir, "results").select("frame_id", made.alias("made_id"), (made == F.col("frame_id")).alias("same"))


def a7_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1.txt"))
    return table(spark, sf_dir, "documents").select("doc_id", P.path_id(paths).alias("path_id"))


def a11_config_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda k, d: C.json_get(F.col("props"), k, d)
    return table(spark, sf_dir, "events").select("event_id", first("page", "none").alias("page"), first("missing.key", "fallback").alias("missing"))


QUERIES = {
    f.__name__: f
    for f in (
        e1_code_parse, e1_code_parse_unstripped, d1_facility_counts, c12_validity, c11_patterns, a8_dictionary, j1_exact_membership, e4_similarities, j2_fuzzy_match, j2_fuzzy_match_all, e7_position_quantity,
        e9_field_assignment, e9_fields, w4_blocks_top_down, j3_code_with_texts, j6_zipped_texts, e29_display, a4_frame_ids, a7_path_ids, a11_config_get,
    )
}

_QR = r"""
qr AS (SELECT *, regexp_extract(s, '^(\d{6})-([A-Z]{2})-([A-Z])-(\d+)-(\d+)(?:/(\d+))?$', ['d', 'f', 't', 'n', 'p', 'r']) AS x, regexp_full_match(s, '\d{6}-[A-Z]{2}-[A-Z]-\d+-\d+(/\d+)?') AS ok
  FROM (SELECT *, regexp_replace(label_data.full_order_code, '^\s+|\s+$', '', 'g') AS s FROM results))"""

# Jaro-Winkler of a and b as a fold; matched places are kept as i * 1000 + j.
_JW = """
jw1 AS (SELECT *, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS w FROM pairs),
jw2 AS (SELECT *, CASE WHEN a = b OR a = '' OR b = '' THEN []::BIGINT[] ELSE list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]), lambda acc, x:
    acc || coalesce([x[1] * 1000 + list_filter(range(greatest(1, x[1] - w), least(length(b), x[1] + w) + 1), lambda j: b[j] = a[x[1]] AND NOT list_contains(list_transform(acc, lambda k: k % 1000), j))[1]], []), []::BIGINT[]) END AS h FROM jw1),
jw3 AS (SELECT *, list_filter(h, lambda k: k IS NOT NULL) AS hits FROM jw2),
jw4 AS (SELECT *, len(hits) AS m, list_sort(list_transform(hits, lambda k: k % 1000)) AS js, (CASE WHEN a[1] = b[1] AND a <> '' AND b <> '' THEN CASE WHEN a[:2] = b[:2] AND length(a) > 1 AND length(b) > 1 THEN
    CASE WHEN a[:3] = b[:3] AND length(a) > 2 AND length(b) > 2 THEN CASE WHEN a[:4] = b[:4] AND length(a) > 3 AND length(b) > 3 THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END ELSE 0 END) AS pre FROM jw3),
jw5 AS (SELECT *, len(list_filter(range(1, m + 1), lambda i: a[hits[i] // 1000] <> b[js[i]])) AS mv FROM jw4),
jw6 AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN m = 0 THEN 0.0 ELSE (m / length(a) + m / length(b) + (m - mv / 2) / m) / 3 END AS jaro FROM jw5),
jw AS (SELECT a, b, levenshtein(a, b) AS edits, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END AS es,
    CASE WHEN a = b THEN 1.0 WHEN m = 0 THEN 0.0 ELSE jaro + pre * 0.1 * (1 - jaro) END AS jws FROM jw6)"""

ORACLES = {
    "e1_code_parse": rf"""WITH {_QR}
SELECT frame_id, load_id, CASE WHEN ok THEN x.d END AS date_code, CASE WHEN ok THEN x.f END AS facility, CASE WHEN ok THEN x.t END AS order_type, CASE WHEN ok THEN x.n END AS order_number,
  CASE WHEN ok THEN try_cast(x.p AS BIGINT) END AS qr_position, CASE WHEN ok THEN CASE WHEN x.r = '' THEN 0 ELSE try_cast(x.r AS BIGINT) END END AS revision_count FROM qr""",
    "e1_code_parse_unstripped": r"""SELECT regexp_extract(c, '-([A-Z]{2})-', 1) AS facility, regexp_extract(c, '-([A-Z])-', 1) AS order_type, count(*) AS n, max(try_cast(regexp_extract(c, '-(\d+)(/\d+)?\n?$', 1) AS BIGINT)) AS max_position
FROM (SELECT label_data.full_order_code AS c FROM results) WHERE regexp_full_match(c, '\d{6}-[A-Z]{2}-[A-Z]-\d+-\d+(/\d+)?\n?') GROUP BY 1, 2""",
    "d1_facility_counts": rf"""WITH {_QR}
SELECT x.f AS facility, count(*) AS n_frames, count(*) FILTER (WHERE try_cast(x.p AS BIGINT) = label_data.ocr_position AND label_data.ocr_position > 0) AS n_valid FROM qr WHERE ok GROUP BY 1""",
    "c12_validity": "SELECT camera_id, coalesce(label_data.qr_position = label_data.ocr_position AND label_data.ocr_position > 0, false) AS valid, count(*) AS n FROM results GROUP BY 1, 2",
    "c11_patterns": r"""SELECT block_id, regexp_full_match(text, '[A-Za-z0-9]{3,9}') AS is_product, regexp_full_match(text, '[A-Z0-9/-]{1,7}') AS is_size, regexp_full_match(text, '[A-Za-z /]{3,}') AS is_color,
  regexp_full_match(text, '\d+\s*/\s*\d+') AS is_position_quantity FROM ocr_blocks""",
    "a8_dictionary": """SELECT list, entry, (row_number() OVER (PARTITION BY list ORDER BY entry))::INT AS ord FROM (
  SELECT DISTINCT 'products' AS list, trim(code) AS entry FROM products UNION SELECT 'sizes', upper(trim(name)) FROM sizes UNION SELECT 'colors', upper(trim(name)) FROM colors) WHERE entry <> ''""",
    "j1_exact_membership": r"""WITH t AS (SELECT DISTINCT text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM ocr_blocks WHERE text IS NOT NULL)
SELECT text, CASE WHEN upper(s) IN (SELECT code FROM products) THEN upper(s) WHEN s IN (SELECT code FROM products) THEN s END AS product,
  CASE WHEN upper(s) IN (SELECT name FROM sizes) THEN upper(s) END AS size, CASE WHEN upper(s) IN (SELECT name FROM colors) THEN upper(s) END AS color FROM t""",
    "e4_similarities": rf"""WITH pairs AS (SELECT DISTINCT upper(regexp_replace(l.label_data.product_code, '^\s+|\s+$', '', 'g')) AS a, upper(regexp_replace(r.label_data.product_code, '^\s+|\s+$', '', 'g')) AS b
  FROM label_records l JOIN results r USING (frame_id) WHERE a IS NOT NULL AND b IS NOT NULL), {_JW}
SELECT a, b, edits::INT AS edits, round(es, 6) AS edit_similarity, round(jws, 6) AS jaro_winkler, greatest(es, jws) >= 0.8 AS is_match FROM jw""",
    "j2_fuzzy_match": rf"""WITH t AS (SELECT DISTINCT text, upper(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS s FROM ocr_blocks WHERE zone = 'color' AND text IS NOT NULL),
pairs AS (SELECT DISTINCT s AS a, name AS b FROM t, colors WHERE s <> ''), {_JW},
best AS (SELECT a, b, greatest(es, jws) AS score FROM jw WHERE greatest(es, jws) > 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY greatest(es, jws) DESC, b) = 1)
SELECT text, coalesce(b, '') AS match, round(coalesce(score, CASE WHEN s = '' THEN 0.0 ELSE 0.9 END), 6) AS score FROM t LEFT JOIN best ON s = a""",
    "e7_position_quantity": rf"""WITH {_QR}, p AS (SELECT frame_id, coalesce(max(CASE WHEN ok THEN try_cast(x.p AS BIGINT) END), 0) AS qr_position FROM qr GROUP BY 1),
b AS (SELECT DISTINCT frame_id, block_no, text, qr_position, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM ocr_blocks JOIN p USING (frame_id)),
c AS (SELECT *, regexp_full_match(s, '\d+\s*/\s*\d+') AS one, CASE WHEN qr_position > 0 AND starts_with(s, qr_position::VARCHAR) THEN substr(s, length(qr_position::VARCHAR) + 1) END AS rest FROM b),
d AS (SELECT *, CASE WHEN one THEN try_cast(regexp_extract(s, '^(\d+)', 1) AS BIGINT) ELSE qr_position END AS position,
  CASE WHEN one THEN try_cast(regexp_extract(s, '(\d+)$', 1) AS BIGINT) ELSE try_cast(right(rest, 1) AS BIGINT) END AS quantity,
  CASE WHEN one THEN 1.0 WHEN regexp_full_match(rest, '[1|lI!tij7][0-9]') THEN 0.9 WHEN regexp_full_match(rest, '[0-9]') THEN 0.85 END::DOUBLE AS factor FROM c)
SELECT frame_id, block_no, text, qr_position, position, quantity, factor FROM d WHERE factor IS NOT NULL AND quantity >= position""",
    "j2_fuzzy_match_all": rf"""WITH t AS (SELECT DISTINCT text, upper(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS s FROM ocr_blocks WHERE text IS NOT NULL),
dict AS (SELECT 'product' AS list, code AS entry FROM products UNION SELECT 'size', upper(trim(name)) FROM sizes UNION SELECT 'color', upper(trim(name)) FROM colors),
pairs AS (SELECT DISTINCT s AS a, upper(entry) AS b FROM t, dict WHERE s <> ''), {_JW},
best AS (SELECT a, list, entry, greatest(es, jws) AS score FROM jw JOIN dict ON b = upper(entry) WHERE greatest(es, jws) > 0.9 QUALIFY row_number() OVER (PARTITION BY a, list ORDER BY greatest(es, jws) DESC, entry) = 1)
SELECT text, k.list AS list, coalesce(entry, '') AS match, round(coalesce(score, CASE WHEN s = '' THEN 0.0 ELSE 0.9 END), 6) AS score FROM (SELECT * FROM t, (SELECT DISTINCT list FROM dict)) k LEFT JOIN best ON best.a = k.s AND best.list = k.list""",
    "e9_fields": rf"""WITH {_QR}, p AS (SELECT frame_id, coalesce(max(CASE WHEN ok THEN try_cast(x.p AS BIGINT) END), 0) AS qr_position FROM qr GROUP BY 1),
t AS (SELECT DISTINCT text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, upper(s) AS u FROM ocr_blocks WHERE text IS NOT NULL),
dict AS (SELECT 'product' AS k, code AS entry FROM products UNION SELECT 'size', upper(trim(name)) FROM sizes UNION SELECT 'color', upper(trim(name)) FROM colors),
usual AS (SELECT text, s, u, 'product' AS k FROM t WHERE regexp_full_match(s, '[A-Za-z0-9]{{3,9}}') UNION ALL SELECT text, s, u, 'size' FROM t WHERE regexp_full_match(u, '[A-Z0-9/-]{{1,7}}')
  UNION ALL SELECT text, s, u, 'color' FROM t WHERE regexp_full_match(u, '[A-Za-z /]{{3,}}')),
exact AS (SELECT text, k, coalesce(max(entry) FILTER (WHERE entry = u), max(entry)) AS entry FROM usual JOIN dict USING (k) WHERE entry = u OR (k = 'product' AND entry = s) GROUP BY ALL),
rest AS (SELECT * FROM usual ANTI JOIN exact USING (text, k)),
pairs AS (SELECT DISTINCT u AS a, upper(entry) AS b FROM rest JOIN dict USING (k) WHERE u <> ''), {_JW},
near AS (SELECT text, k, entry, greatest(es, jws) AS score FROM rest JOIN dict USING (k) JOIN jw ON a = u AND b = upper(entry) WHERE greatest(es, jws) > 0.9
  QUALIFY row_number() OVER (PARTITION BY text, k ORDER BY greatest(es, jws) DESC, entry) = 1),
hit AS (SELECT text, k, entry, 1.0::DOUBLE AS score FROM exact UNION ALL SELECT * FROM near),
m AS (SELECT text, max(entry) FILTER (WHERE k = 'product') AS pe, max(score) FILTER (WHERE k = 'product') AS ps, max(entry) FILTER (WHERE k = 'size') AS se, max(score) FILTER (WHERE k = 'size') AS ss,
  max(entry) FILTER (WHERE k = 'color') AS ce, max(score) FILTER (WHERE k = 'color') AS cs FROM hit GROUP BY 1),
fr AS (SELECT frame_id, qr_position FROM p SEMI JOIN ocr_blocks USING (frame_id)),
b0 AS (SELECT DISTINCT frame_id, text, coalesce(confidence, 0.0) AS c, bbox[1][2] AS y, block_id FROM ocr_blocks WHERE text IS NOT NULL AND bbox[1][2] IS NOT NULL),
b1 AS (SELECT b0.*, qr_position, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, row_number() OVER (PARTITION BY frame_id ORDER BY y, block_id, text, c) AS i FROM b0 JOIN fr USING (frame_id)),
b2 AS (SELECT *, regexp_full_match(s, '\d+\s*/\s*\d+') AS one, CASE WHEN qr_position > 0 AND starts_with(s, qr_position::VARCHAR) THEN substr(s, length(qr_position::VARCHAR) + 1) END AS tail FROM b1),
b3 AS (SELECT *, CASE WHEN one THEN try_cast(regexp_extract(s, '^(\d+)', 1) AS BIGINT) ELSE qr_position END AS po, CASE WHEN one THEN try_cast(regexp_extract(s, '(\d+)$', 1) AS BIGINT) ELSE try_cast(right(tail, 1) AS BIGINT) END AS qu,
  CASE WHEN one THEN 1.0 WHEN regexp_full_match(tail, '[1|lI!tij7][0-9]') THEN 0.9 WHEN regexp_full_match(tail, '[0-9]') THEN 0.85 END::DOUBLE AS fa FROM b2),
b AS (SELECT b3.* EXCLUDE (fa), CASE WHEN qu >= po THEN fa END AS fa, pe, ps, se, ss, ce, cs FROM b3 LEFT JOIN m USING (text)),
x0 AS (SELECT frame_id, min(i) AS i0 FROM b WHERE fa IS NOT NULL GROUP BY 1),
x1 AS (SELECT x0.*, (SELECT min(i) FROM b WHERE b.frame_id = x0.frame_id AND pe IS NOT NULL AND i > i0) AS i1 FROM x0),
x2 AS (SELECT x1.*, (SELECT min(i) FROM b WHERE b.frame_id = x1.frame_id AND se IS NOT NULL AND i > greatest(i0, coalesce(i1, 0))) AS i2 FROM x1),
x3 AS (SELECT x2.*, (SELECT min(i) FROM b WHERE b.frame_id = x2.frame_id AND ce IS NOT NULL AND i > greatest(i0, coalesce(i1, 0), coalesce(i2, 0))) AS i3 FROM x2),
sp AS (SELECT b.* FROM b JOIN x3 USING (frame_id) WHERE i NOT IN (i0, coalesce(i1, 0), coalesce(i2, 0), coalesce(i3, 0))),
x AS (SELECT x3.*, coalesce(i1, (SELECT min(i) FROM sp WHERE sp.frame_id = x3.frame_id AND pe IS NOT NULL)) AS j1, coalesce(i2, (SELECT min(i) FROM sp WHERE sp.frame_id = x3.frame_id AND se IS NOT NULL)) AS j2,
  coalesce(i3, (SELECT min(i) FROM sp WHERE sp.frame_id = x3.frame_id AND ce IS NOT NULL)) AS j3 FROM x3)
SELECT fr.frame_id, fr.qr_position, coalesce(q.po::VARCHAR || '/' || q.qu::VARCHAR, '') AS position_quantity, coalesce(q.po, 0) AS ocr_position, coalesce(q.qu, 0) AS quantity, coalesce(b1_.pe, '') AS product_code, coalesce(b2_.se, '') AS size,
  coalesce(b3_.ce, '') AS color, coalesce(fr.qr_position = q.po AND q.po > 0, false) AS is_valid, round(q.c * q.fa, 6) AS position_conf, round(b1_.c * b1_.ps * CASE WHEN i1 IS NULL THEN 0.8 ELSE 1 END, 6) AS product_conf,
  round(b2_.c * b2_.ss * CASE WHEN i2 IS NULL THEN 0.8 ELSE 1 END, 6) AS size_conf, round(b3_.c * b3_.cs * CASE WHEN i3 IS NULL THEN 0.8 ELSE 1 END, 6) AS color_conf
FROM fr LEFT JOIN x USING (frame_id) LEFT JOIN b q ON q.frame_id = fr.frame_id AND q.i = i0 LEFT JOIN b b1_ ON b1_.frame_id = fr.frame_id AND b1_.i = j1
  LEFT JOIN b b2_ ON b2_.frame_id = fr.frame_id AND b2_.i = j2 LEFT JOIN b b3_ ON b3_.frame_id = fr.frame_id AND b3_.i = j3""",
    "w4_blocks_top_down": """SELECT frame_id, string_agg(coalesce(text, ''), '|' ORDER BY y, block_id, text) AS texts FROM (SELECT DISTINCT frame_id, block_id, text, bbox[1][2] AS y FROM ocr_blocks WHERE len(bbox) > 0) GROUP BY 1""",
    "j3_code_with_texts": rf"""WITH {_QR}, t AS (SELECT frame_id, count(DISTINCT block_id) AS n_blocks FROM ocr_blocks GROUP BY 1)
SELECT DISTINCT frame_id, x.n AS order_number, try_cast(x.p AS BIGINT) AS position, n_blocks FROM qr JOIN t USING (frame_id) WHERE ok""",
    "j6_zipped_texts": """WITH a AS (SELECT frame_id, list(text ORDER BY block_id, text) AS texts, list(confidence ORDER BY block_id, text) FILTER (WHERE confidence IS NOT NULL) AS scores
  FROM (SELECT DISTINCT frame_id, block_id, text, confidence FROM ocr_blocks WHERE text IS NOT NULL) GROUP BY 1)
SELECT frame_id, (i - 1)::INT AS i, texts[i] AS text, coalesce(scores[i], 0.0) AS score FROM a, unnest(range(1, len(texts) + 1)) AS t(i)""",
    "e29_display": """SELECT frame_id, CASE WHEN coalesce(label_data.order_type, '') <> '' AND coalesce(label_data.order_number, '') <> '' THEN label_data.order_type || '-' || label_data.order_number ELSE '--' END AS order_text,
  coalesce(nullif(nullif(label_data.qr_position::VARCHAR, ''), '0'), '--') AS position, coalesce(nullif(nullif(label_data.size, ''), '0'), '--') AS size,
  CASE WHEN coalesce(label_data.is_valid, false) THEN 'VALID' ELSE 'INVALID' END AS validity FROM results""",
    "a4_frame_ids": "SELECT frame_id, camera_id || '_frame_' || strftime(captured_at, '%Y%m%d_%H%M%S_%g') AS made_id, made_id = frame_id AS same FROM results",
    "a7_path_ids": "SELECT doc_id, replace(regexp_replace(source || '/' || doc_id::VARCHAR || '.v1.txt', '\\.[^./]+$', ''), '/', '_') AS path_id FROM documents",
    "a11_config_get": "SELECT event_id, coalesce(props->>'$.page', 'none') AS page, coalesce(props->>'$.missing.key', 'fallback') AS missing FROM events",
}
