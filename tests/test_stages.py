import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tagweave.operators.images import IMAGE, to_row
from tagweave.plans import engines as E
from tagweave.plans import stages as S
from tagweave.plans.pipeline import Pipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the engines below go to workers, which can't import this file


def frames(spark):
    image = np.full((400, 600, 3), 30, np.uint8)
    image[100:300, 100:500] = 200
    rows = [("read", to_row(image)), ("nothing", to_row(np.zeros((50, 60, 3), np.uint8))), ("dark", to_row(image // 4)), ("lost", None)]
    return spark.createDataFrame(rows, f"frame_id string, image {IMAGE.simpleString()}")


def detector():
    class Box:
        def detect(self, image, threshold):
            return [E.Detection("label", 0.7, (0, 0, 600, 400)), E.Detection("label", 0.9, (100, 100, 500, 300))] if image.shape[1] == 600 else []

    return Box()


def reader():
    class Code:
        def read(self, image):
            return E.Code("110825-VA-M-000547-2", ((280, 40), (380, 40), (380, 140), (280, 140))) if image.max() > 100 else None

    return Code()


def recogniser():
    class Texts:
        def read(self, image):
            at = lambda y: ((0.0, y), (9.0, y), (9.0, y + 5), (0.0, y + 5))
            return [E.Block(t, 0.9, at(y)) for t, y in (("2/2", 3.0), ("5000", 93.0), ("M", 145.0), ("DARK HEATHER", 185.0))]

    return Texts()


def dictionaries(spark):
    one = lambda *v: spark.createDataFrame([(x, i) for i, x in enumerate(v)], "entry string, ord int")
    return {"product": one("5000"), "size": one("M"), "color": one("DARK HEATHER")}


def test_all_stages_in_a_row(spark):
    stages = (S.s1_captured(), S.s2_detection(detector), S.s3_preprocessing(), S.s4_enhancement(sharp=False), S.s5_code(reader), S.s6_components(), S.s7_texts(recogniser), S.s8_fields(dictionaries(spark)))
    got = {r.frame_id: r for r in Pipeline("frame_id", stages).apply(frames(spark)).collect()}
    assert {k: r.error for k, r in got.items()} == {"read": None, "nothing": "No label detected", "dark": "No QR code detected", "lost": "Failed to read image"}
    r = got["read"]
    assert len(r.detections) == 1 and r.detections[0].bbox == [100, 100, 500, 300] and (r.crop.w, r.crop.h, r.enhanced.c) == (400, 200, 1)
    assert r.qr.position == 2 and r.code.polygon[0] == [280, 40] and (r.components.w, r.components.h) == (275, 36 * 2 + 3 + 110)
    assert (r.label_data.product_code, r.label_data.size, r.label_data.color, r.label_data.is_valid) == ("5000", "M", "DARK HEATHER", True)
    assert got["nothing"].crop is None and got["dark"].crop is not None and got["dark"].label_data is None


def test_switched_off_stages(spark):
    one = frames(spark).where("frame_id = 'read'")
    off = Pipeline("frame_id", (S.s2_detection(detector), S.s3_preprocessing(enabled=False))).apply(one).first()
    assert off.error == "Preprocessing disabled"
    plain = Pipeline("frame_id", (S.s2_detection(detector), S.s3_preprocessing(), S.s4_enhancement(enabled=False), S.s5_code(reader), S.s6_components(), S.s7_texts(recogniser, enabled=False))).apply(one).first()
    assert plain.success and plain.enhanced.c == 3 and plain.text_blocks == []


def test_work_that_fails_fails_its_row_alone(spark):
    def bad():
        return lambda image, more: 1 / 0 if image.shape[0] == 50 else {"text": "x"}

    got = {r.frame_id: r.x for r in frames(spark).select("frame_id", S.told(F.col("image"), bad, "STRUCT<text: STRING>").alias("x")).collect()}
    assert got["nothing"] is None and got["lost"] is None and got["read"].text == "x"
