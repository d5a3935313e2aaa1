"""The eight services as ready stages of a ``Pipeline`` over rows of ``frame_id`` and ``image``; models are built once a task."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions import geometry as G
from tagweave.functions import pixels
from tagweave.functions.codes import parse_code
from tagweave.operators import detect as D
from tagweave.operators.fields import assign_fields
from tagweave.operators.images import IMAGE, to_array, to_row
from tagweave.plans import engines
from tagweave.plans.pipeline import STAGE_ERRORS, Stage

_NOTED = T.StructType([*IMAGE.fields, T.StructField("note", T.StringType())])
_FOUND = "ARRAY<STRUCT<class_name: STRING, confidence: DOUBLE, bbox: ARRAY<INT>, has_mask: BOOLEAN, contour: ARRAY<ARRAY<INT>>>>"
_CODE = "STRUCT<text: STRING, polygon: ARRAY<ARRAY<INT>>, confidence: DOUBLE, factor: DOUBLE>"
_BLOCKS = "ARRAY<STRUCT<text: STRING, confidence: DOUBLE, bbox: ARRAY<ARRAY<DOUBLE>>>>"
Work = Callable[[np.ndarray, str | None], object]


def _fields(image: Column) -> tuple[Column, ...]:
    return image["h"], image["w"], image["c"], image["data"]


def _each(work: Work, h, w, c, data, more) -> Iterator[object]:
    for one in zip(h, w, c, data, more):
        try:
            yield None if one[3] is None else work(to_array(*(int(v) for v in one[:3]), one[3]), one[4])
        except Exception:  # errors are data: the row fails its stage, the job goes on
            yield None


def told(image: Column, build: Callable[[], Work], kind: str, more: Column | None = None) -> Column:
    """What the work built by ``build``, once a task, tells of every image (and a text ``more``), as ``kind``; null where it fails."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        work = build()
        for part in parts:
            yield pd.Series([None if x is None else json.dumps(x) for x in _each(work, *part)], dtype=object)

    return F.from_json(run(*_fields(image), F.lit(None).cast("string") if more is None else more), kind)


def drawn(image: Column, build: Callable[[], Work], more: Column | None = None) -> Column:
    """The image and note that the work gives for every image, as ``IMAGE`` with ``note``; a null image with its note where it gives none."""

    @F.pandas_udf(_NOTED)
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        work = build()
        for part in parts:
            rows = []
            for made in _each(work, *part):
                out, note = made or (None, None)
                rows.append((dict.fromkeys("hwc") | {"data": None} if out is None or out.size == 0 else to_row(out)) | {"note": note})
            yield pd.DataFrame(rows, columns=["h", "w", "c", "data", "note"]).astype({k: "Int32" for k in "hwc"})

    return run(*_fields(image), F.lit(None).cast("string") if more is None else more)


def _image(made: Column) -> Column:
    return F.when(made["data"].isNotNull(), F.struct(*[made[k].alias(k) for k in ("h", "w", "c", "data")]))


def s1_captured() -> Stage:
    """A frame that was read: it has an image. Adds nothing."""
    return Stage("s1", lambda rows: rows, F.col("image").isNotNull(), "Failed to read image")


def s2_detection(build: Callable[[], engines.Detector], threshold: float = 0.5, max_ratio: float = 0.4, top: int = 1) -> Stage:
    """Adds ``detections``: those above the threshold and within the share of the image, the ``top`` (at least 1) most confident."""

    def work() -> Work:
        detector = build()

        def run(image: np.ndarray, _: str | None) -> list[dict]:
            out = []
            for d in detector.detect(image, threshold):
                contour = None if d.mask is None else pixels.largest_contour(d.mask)
                x1, y1, x2, y2 = d.box
                points = [[x1, y1], [x2, y1], [x2, y2], [x1, y2]] if contour is None else np.asarray(contour).reshape(-1, 2).astype(int).tolist()
                out.append({"class_name": d.name, "confidence": d.confidence, "bbox": list(d.box), "has_mask": d.mask is not None, "contour": points})
            return out

        return run

    def add(rows: DataFrame) -> DataFrame:
        small = F.filter("found", lambda d: D.small_enough(d["bbox"], F.col("image.w"), F.col("image.h"), max_ratio))
        ranked = F.array_sort(small, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
        return rows.withColumn("found", told(F.col("image"), work, _FOUND)).withColumn("detections", F.slice(ranked, 1, max(top, 1))).drop("found")

    return Stage("s2", add, F.size("detections") > 0, STAGE_ERRORS["s2"])


def s3_preprocessing(force_landscape: bool = True, classify: Callable[[], Callable] | None = None, threshold: float = 0.6, enabled: bool = True) -> Stage:
    """Adds ``crop`` (the first detection's label, cut out upright) and ``crop_message``. ``classify`` builds the orientation model."""

    def work() -> Work:
        model = classify() if classify else None
        return lambda image, points: pixels.preprocess(image, np.array(json.loads(points)) if points else None, force_landscape, model, threshold)

    def add(rows: DataFrame) -> DataFrame:
        made = rows.withColumn("made", drawn(F.col("image"), work, F.to_json(F.get("detections", F.lit(0))["contour"])))
        return made.withColumns({"crop": _image(F.col("made")), "crop_message": F.col("made.note")}).drop("made")

    return Stage("s3", add, F.col("crop").isNotNull(), STAGE_ERRORS["s3"], enabled, "fail", STAGE_ERRORS["s3_off"])


def s4_enhancement(bright: bool = True, sharp: bool = True, enabled: bool = True, **settings: float) -> Stage:
    """Adds ``enhanced``, the gray crop brightened and sharpened as switched on; switched off, the crop as it is."""

    def add(rows: DataFrame) -> DataFrame:
        if not enabled:
            return rows.withColumn("enhanced", F.col("crop"))
        made = rows.withColumn("made", drawn(F.col("crop"), lambda: lambda image, _: (pixels.enhance(image, bright, sharp, **settings)[0], None)))
        return made.withColumn("enhanced", _image(F.col("made"))).drop("made")

    return Stage("s4", add, F.col("enhanced").isNotNull(), STAGE_ERRORS["s3"])


def s5_code(build: Callable[[], engines.CodeReader], prepare: bool = False, mode: str = "full", target: int = 480) -> Stage:
    """Adds ``code`` (text, polygon in the crop's pixels, confidence) and ``qr``, its parts; null parts where the text is no order code."""

    def work() -> Work:
        reader = build()

        def run(image: np.ndarray, _: str | None) -> dict | None:
            ready, factor = pixels.prepare_for_code(image, prepare, mode, target)
            found = reader.read(ready)
            return found and {"text": found.text, "polygon": [list(p) for p in found.polygon], "confidence": found.confidence, "factor": factor}

        return run

    def add(rows: DataFrame) -> DataFrame:
        raw = F.col("code")
        rows = rows.withColumn("code", told(F.col("enhanced"), work, _CODE))
        back = F.struct(raw["text"].alias("text"), G.scale_back(raw["polygon"], raw["factor"]).alias("polygon"), raw["confidence"].alias("confidence"))
        return rows.withColumn("code", F.when(raw.isNotNull(), back)).withColumn("qr", parse_code(F.col("code.text")))

    return Stage("s5", add, F.col("code.text").isNotNull(), STAGE_ERRORS["s5"])


def s6_components(regions: G.Regions = G.Regions()) -> Stage:
    """Adds ``components``: the regions above and beside the code merged into one image."""

    def add(rows: DataFrame) -> DataFrame:
        rect, w, h = G.bounding_rect(F.col("code.polygon")), F.col("enhanced.w"), F.col("enhanced.h")
        both = F.to_json(F.struct(G.region_above(rect, w, h, regions).alias("a"), G.region_below(rect, w, h, regions).alias("b")))

        def cut(image: np.ndarray, boxes: str | None) -> tuple[np.ndarray, None]:
            a, b = (image[v["y1"] : v["y2"], v["x1"] : v["x2"]] for v in (json.loads(boxes)[k] for k in "ab"))
            return pixels.merge_regions(a, b, regions.above_scale), None

        return rows.withColumn("made", drawn(F.col("enhanced"), lambda: cut, both)).withColumn("components", _image(F.col("made"))).drop("made")

    return Stage("s6", add, F.col("components").isNotNull(), STAGE_ERRORS["s6"])


def s7_texts(build: Callable[[], engines.Recogniser], enabled: bool = True) -> Stage:
    """Adds ``text_blocks``; none are a success too."""

    def work() -> Work:
        reader = build()
        return lambda image, _: [{"text": b.text, "confidence": b.confidence, "bbox": [list(p) for p in b.box]} for b in reader.read(image)]

    def add(rows: DataFrame) -> DataFrame:
        none = F.from_json(F.lit("[]"), _BLOCKS)
        return rows.withColumn("text_blocks", F.coalesce(told(F.col("components"), work, _BLOCKS), none) if enabled else none)

    return Stage("s7", add, F.lit(True), STAGE_ERRORS["s8"])


def s8_fields(dictionaries: dict[str, DataFrame], min_score: float = 0.9) -> Stage:
    """Adds ``label_data``: the fields that the blocks tell, and whether the positions of code and text agree. Frame ids must be unique."""

    def add(rows: DataFrame) -> DataFrame:
        blocks = rows.select("frame_id", F.posexplode("text_blocks").alias("i", "b")).select("frame_id", "i", "b.text", "b.confidence", F.get(F.get("b.bbox", F.lit(0)), F.lit(1)).alias("y"))
        labels = rows.select("frame_id", F.coalesce("qr.position", F.lit(0).cast("bigint")).alias("qr_position"))
        told_ = assign_fields(labels, "frame_id", "qr_position", blocks, "text", "confidence", "y", "i", dictionaries, min_score)
        fields = told_.select(F.col("frame_id").alias("__f"), F.struct(*[c for c in told_.columns if c != "frame_id"]).alias("label_data"))
        return rows.join(fields, rows["frame_id"] == fields["__f"], "left").drop("__f")

    return Stage("s8", add, F.col("qr").isNotNull() & (F.col("label_data.ocr_position") > 0), STAGE_ERRORS["s8"])
