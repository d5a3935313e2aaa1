"""Detections: candidate decoding, filters, non-maximum suppression, top-N and mask arithmetic, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.runtime import let


def best_class(scores: Column) -> Column:
    """``class_id, confidence`` of a score array: the first of the greatest; null for null and empty arrays."""
    top = F.array_max(scores)
    return F.when(F.size(scores) > 0, F.struct((F.array_position(scores, top) - 1).cast("int").alias("class_id"), top.alias("confidence")))


def rows_first(first: Column | int, n_classes: int, masks: int = 32, slack: int = 10) -> Column:
    """Whether a detector's output with ``first`` as its first dimension has its candidates in the second and must be turned: a box,
    the class scores, mask coefficients and some slack are fewer than candidates ever are."""
    return (F.lit(first) if isinstance(first, int) else first) <= 4 + n_classes + masks + slack


def candidates(output: Column, n_classes: int, masks: int = 0) -> Column:
    """The candidates of an output (``ARRAY<ARRAY<DOUBLE>>``) in either layout: an array of ``STRUCT<box, scores, coefficients>``; rows of
    fewer than five numbers are no candidates, missing scores end the row. Null for a null output, empty for an empty one."""
    width = F.array_max(F.transform(output, lambda r: F.size(r)))
    turned = F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.transform(output, lambda r: F.get(r, i)))
    rows = F.when(F.coalesce(width, F.lit(0)) < 1, output).when(rows_first(F.size(output), n_classes, masks), turned).otherwise(output)
    full = F.filter(rows, lambda r: F.size(r) >= 5)
    return F.transform(full, lambda r: F.struct(F.slice(r, 1, 4).alias("box"), F.slice(r, 5, n_classes).alias("scores"), F.slice(r, 5 + n_classes, max(masks, 0)).alias("coefficients")))


def class_name(class_id: Column, names: list[str]) -> Column:
    """Name of a class, ``unknown`` outside the list."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), class_id), F.lit("unknown"))


def first_code(results: Column, reader: str) -> Column:
    """The text of the reader's result that counts, of an array of ``STRUCT<text STRING, valid BOOLEAN>``; null if none does.

    ``zxing``: the first valid result, even with an empty text. ``wechat``: the first result with a text, but none at all if the
    very first has none. ``pyzbar``: the very first result, whatever it holds.
    """
    first = F.get(results, F.lit(0))
    with_text = lambda r: F.coalesce(r["text"], F.lit("")) != ""
    chosen = {
        "zxing": F.get(F.filter(results, lambda r: F.coalesce(r["valid"], F.lit(False))), F.lit(0)),
        "wechat": F.when(with_text(first), F.get(F.filter(results, with_text), F.lit(0))),
        "pyzbar": first,
    }
    return chosen[reader]["text"]


def passes_confidence(confidence: Column, threshold: float) -> Column:
    """The candidate filter and the suppression kernel's own together: strictly above the threshold."""
    return F.coalesce(confidence > threshold, F.lit(False))


def clamped(value: float, low: float = 0.0, high: float = 1.0) -> float:
    return min(max(value, low), high)


def decode_box(xc: Column, yc: Column, w: Column, h: Column, sx: Column, sy: Column, width: Column, height: Column, clip: str = "inner") -> Column:
    """``x1, y1, x2, y2`` in pixels of the original image, cut towards zero. ``clip``: ``outer`` bounds the first corner below and
    the second above, ``inner`` bounds both corners within the image's pixels on both sides."""
    x1, y1 = ((xc - w / 2) * sx).cast("int"), ((yc - h / 2) * sy).cast("int")
    x2, y2 = ((xc + w / 2) * sx).cast("int"), ((yc + h / 2) * sy).cast("int")
    zero = F.lit(0)
    if clip == "outer":
        box = F.greatest(zero, x1), F.greatest(zero, y1), F.least(width, x2), F.least(height, y2)
    else:
        within = lambda v, top: F.least(F.greatest(zero, v), top)
        box = within(x1, width - 1), within(y1, height - 1), within(x2, width), within(y2, height)
    return F.struct(*[c.cast("int").alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))])


def box_area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def small_enough(box: Column, width: Column, height: Column, max_ratio: float = 0.4) -> Column:
    """Whether the box covers at most ``max_ratio`` of the image; false for a null box."""
    return F.coalesce(box_area(box) <= width * height * clamped(max_ratio), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes over their union, 0 if the union is empty."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = (w * h).cast("double")
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def suppress(boxes: Column, threshold: float = 0.45, cap: int = 100, cap_candidates: bool = False) -> Column:
    """Greedy non-maximum suppression over an array of ``STRUCT<confidence, ord, box>``, as a fold.

    Boxes are taken by falling confidence, then ``ord``; one is kept unless it overlaps a kept one by more than ``threshold``. At
    most ``cap`` are kept, or with ``cap_candidates`` looked at.
    """
    ranked = F.array_sort(boxes, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    if cap_candidates:
        ranked = F.slice(ranked, 1, cap)

    def fold(sorted_: Column) -> Column:
        kept = F.aggregate(sorted_, F.slice(sorted_, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k["box"], x["box"]) > threshold), acc).otherwise(F.concat(acc, F.array(x))))
        return F.slice(kept, 1, cap)

    return let(ranked, fold)


def nms(detections: DataFrame, frame: str, confidence: str, box: str, ord_: str, min_confidence: float = 0.5, threshold: float = 0.45, cap: int = 100, keep: tuple[str, ...] = (), cap_candidates: bool = False) -> DataFrame:
    """``frame, ord_, confidence, box, *keep, rank``: the boxes of each frame that survive, ranked by confidence.

    At most ``cap`` boxes of a frame are kept, or with ``cap_candidates`` looked at (the two back-ends differ in this). Null frames,
    confidences and boxes are left out. A frame holds what one image holds; the filter comes before the shuffle.
    """
    rows = detections.where(F.col(frame).isNotNull() & passes_confidence(F.col(confidence), min_confidence) & F.col(box).isNotNull())
    entry = F.struct(F.col(confidence).alias("confidence"), F.col(ord_).alias("ord"), F.col(box).alias("box"), *keep)
    kept = rows.groupBy(frame).agg(suppress(F.collect_list(entry), threshold, cap, cap_candidates).alias("kept"))
    out = kept.select(frame, F.posexplode("kept").alias("i", "k"))
    return out.select(frame, F.col("k.ord").alias(ord_), F.col("k.confidence").alias(confidence), F.col("k.box").alias(box), *[F.col(f"k.{c}").alias(c) for c in keep], (F.col("i") + 1).alias("rank"))


def top_n(detections: DataFrame, frame: str, confidence: str, ord_: str, n: int = 2) -> DataFrame:
    """The ``max(n, 1)`` most confident rows of each frame, ties by ``ord_``; Spark limits each group before the shuffle."""
    w = W.partitionBy(frame).orderBy(F.desc_nulls_last(confidence), ord_)
    return detections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(n, 1))


def mask_value(coefficients: Column, prototype: Column) -> Column:
    """Sigmoid of the dot product of mask coefficients with one prototype pixel."""
    dot = F.aggregate(F.zip_with(coefficients, prototype, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 / (1 + F.exp(-dot))


def binarize(mask: Column, threshold: float = 0.5) -> Column:
    """255 above the threshold, else 0."""
    return F.transform(mask, lambda v: F.when(v > threshold, 255).otherwise(0))


def coverage(mask: Column) -> Column:
    """Percentage of set pixels in a mask of 0 and 1 (or 0 and 255); null for an empty mask."""
    return F.when(F.size(mask) > 0, F.size(F.filter(mask, lambda v: v > 0)) * 100.0 / F.size(mask))
