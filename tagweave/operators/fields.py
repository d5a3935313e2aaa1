"""Text blocks of a label turned into its fields: position and quantity, product, size and color, then validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import patterns as P
from tagweave.operators.dictionary import exact_match, fuzzy_match
from tagweave.runtime import cut_lineage, let

_TRIM = r"^\s+|\s+$"
_FIELDS = ("product", "size", "color")


def position_quantity(text: Column, position: Column) -> Column:
    """``position, quantity, factor`` read from one text, null if it tells none.

    ``3/5`` as printed counts fully. If the position is known from the code (above 0) and the text begins with it, a misread
    slash and one digit count 0.9, one digit alone 0.85. The quantity is never below the position.
    """
    t = F.regexp_replace(text, _TRIM, "")
    a, b = F.regexp_extract(t, P.POSITION_QUANTITY, 1).try_cast("bigint"), F.regexp_extract(t, P.POSITION_QUANTITY, 2).try_cast("bigint")
    known = F.when(position > 0, position)
    rest = F.when(F.startswith(t, known.cast("string")), F.substring(t, F.length(known.cast("string")) + 1, F.length(t)))
    digit = F.right(rest, F.lit(1)).try_cast("bigint")
    told = lambda p, q, f: F.when(q >= p, F.struct(p.cast("bigint").alias("position"), q.alias("quantity"), F.lit(f).alias("factor")))
    return (
        F.when(t.rlike(P.POSITION_QUANTITY), told(a, b, 1.0))
        .when(rest.rlike(rf"^[{P.MISREAD_SLASH}][0-9]$"), told(known, digit, 0.9))
        .when(rest.rlike("^[0-9]$"), told(known, digit, 0.85))
    )


def block_matches(blocks: DataFrame, text: str, dictionaries: dict[str, DataFrame], min_score: float = 0.9) -> DataFrame:
    """``raw, product, size, color`` of each distinct text: per field ``STRUCT<value, score>`` or null.

    A text must have the field's usual form; an exact entry scores 1, else the best fuzzy entry above ``min_score`` counts. Done
    once for each distinct text, whatever the number of blocks.
    """
    distinct = cut_lineage(blocks.select(F.col(text).alias("raw")).where("raw is not null").distinct())  # read for every field
    t = F.regexp_replace("raw", _TRIM, "")
    forms = {"product": P.is_product(t), "size": P.is_size(F.upper(t)), "color": P.is_color(F.upper(t))}
    out = distinct
    for field in _FIELDS:
        entries = dictionaries[field]
        seen = exact_match(distinct.where(forms[field]), "raw", entries, keep_case=field == "product")
        hit = seen.where("match is not null").select("raw", F.struct(F.col("match").alias("value"), F.lit(1.0).alias("score")).alias(field))
        near = fuzzy_match(seen.where("match is null").select("raw"), "raw", entries, min_score).where("match <> ''")
        near = near.select("raw", F.struct(F.col("match").alias("value"), "score").alias(field))
        out = out.join(hit.unionByName(near), "raw", "left")
    return out


def _first(found: Column, field: str, after: Column) -> Column:
    """Index of the first block from ``after`` on that tells the field, -1 if none."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0))), lambda i: (i >= after) & (i < F.size(found)) & F.get(found, i)[field].isNotNull())
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def assign_fields(labels: DataFrame, frame: str, position: str, blocks: DataFrame, text: str, confidence: str, y: str, order: str, dictionaries: dict[str, DataFrame], min_score: float = 0.9) -> DataFrame:
    """One row per label: ``frame, qr_position, position_quantity, ocr_position, quantity, product_code, size, color, is_valid, field_confidences``.

    Blocks are taken from top to bottom (``y``, then ``order``). The first block that tells position and quantity is required;
    product, size and color follow each other below it. A field not found there is taken from any unused block at 0.8 of its
    confidence; one block may then fill two fields. Valid if the positions of code and text agree and are above 0.

    ``labels`` holds one row per frame with the code's position; frames without blocks, or whose blocks have no position, get
    empty fields and ``is_valid`` false. Blocks with null text or y are left out, a null confidence counts 0, exact repeats of a
    block count once. No row loop: matches are per text, and the order rules are array look-ups within a frame.
    """
    matches = block_matches(blocks, text, dictionaries, min_score)
    b = blocks.select(F.col(frame).alias("f"), F.col(text).alias("raw"), F.coalesce(confidence, F.lit(0.0)).alias("c"), F.col(y).alias("y"), F.col(order).alias("o")).where("raw is not null and y is not null").distinct()
    lists = b.join(matches, "raw").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("y", "o", "raw", "c", *_FIELDS))).alias("b"))
    rows = labels.select(F.col(frame), F.col(position).alias("qr_position")).join(lists, F.col(frame) == F.col("f"), "left").drop("f")
    rows = rows.withColumn("b", F.coalesce("b", F.expr("array()").cast(lists.schema["b"].dataType)))

    told = F.transform("b", lambda x: F.struct(x["c"].alias("c"), *[x[n].alias(n) for n in _FIELDS], position_quantity(x["raw"], F.col("qr_position")).alias("pq")))
    rows = rows.withColumn("b", told)
    blocks_ = F.col("b")
    i0 = _first(blocks_, "pq", F.lit(0))
    rows = rows.withColumn("i0", i0)
    rows = rows.withColumn("i1", F.when(F.col("i0") >= 0, _first(blocks_, "product", F.col("i0") + 1)).otherwise(-1))
    rows = rows.withColumn("i2", F.when(F.col("i0") >= 0, _first(blocks_, "size", F.greatest("i0", "i1") + 1)).otherwise(-1))
    rows = rows.withColumn("i3", F.when(F.col("i0") >= 0, _first(blocks_, "color", F.greatest("i0", "i1", "i2") + 1)).otherwise(-1))

    used = F.array("i0", "i1", "i2", "i3")
    spare = F.filter(F.transform("b", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: ~F.array_contains(used, z["i"]))

    def field(name: str, at: str) -> Column:
        direct = F.get("b", F.col(at))
        left = F.get(F.filter(spare, lambda z: z["x"][name].isNotNull()), F.lit(0))["x"]
        value = lambda x, k: F.struct(x[name]["value"].alias("value"), (x["c"] * x[name]["score"] * k).alias("confidence"))
        return F.when(F.col("i0") < 0, F.lit(None)).when(F.col(at) >= 0, value(direct, 1.0)).when(left.isNotNull(), value(left, 0.8))

    rows = rows.select(
        frame, "qr_position", let(F.get("b", F.when(F.col("i0") >= 0, F.col("i0"))), lambda x: F.struct(x["pq"].alias("pq"), x["c"].alias("c"))).alias("p"), *[field(n, at).alias(n) for n, at in zip(_FIELDS, ("i1", "i2", "i3"))]
    )
    pq = F.col("p.pq")
    text_of = lambda n: F.coalesce(F.col(f"{n}.value"), F.lit(""))
    confidences = F.map_from_entries(F.array_compact(F.array(
        F.when(pq.isNotNull(), F.struct(F.lit("positionQuantity").alias("key"), (F.col("p.c") * pq["factor"]).alias("value"))),
        *[F.when(F.col(n).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(f"{n}.confidence").alias("value"))) for n, k in (("product", "productCode"), ("size", "size"), ("color", "color"))],
    )))
    return rows.select(
        frame,
        "qr_position",
        F.coalesce(F.concat_ws("/", pq["position"].cast("string"), pq["quantity"].cast("string")), F.lit("")).alias("position_quantity"),
        F.coalesce(pq["position"], F.lit(0)).alias("ocr_position"),
        F.coalesce(pq["quantity"], F.lit(0)).alias("quantity"),
        text_of("product").alias("product_code"),
        text_of("size").alias("size"),
        text_of("color").alias("color"),
        F.coalesce((F.col("qr_position") == pq["position"]) & (pq["position"] > 0), F.lit(False)).alias("is_valid"),
        confidences.alias("field_confidences"),
    )
