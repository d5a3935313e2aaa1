from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import detect as D
from tagweave.operators.images import to_array, with_model
from tagweave.plans import engines as E
from tagweave.plans.plugins import CODE_READERS, DETECTORS, RECOGNISERS


def model_rows(n_classes=2):
    # x, y, w, h of 640, scores: two overlapping boxes, one of another class, one under the threshold
    rows = np.zeros((84, 4 + n_classes))
    rows[0] = [320, 320, 100, 100, 0.9, 0.1]
    rows[1] = [325, 320, 100, 100, 0.8, 0.1]
    rows[2] = [640, 640, 80, 80, 0.2, 0.7]
    rows[3] = [100, 100, 50, 50, 0.5, 0.5]
    return rows


class Session:
    def __init__(self, outputs):
        self.outputs = outputs

    def get_inputs(self):
        return [SimpleNamespace(name="images")]

    def run(self, _, feed):
        assert feed["images"].shape == (1, 3, 640, 640) and feed["images"].dtype == np.float32
        return self.outputs


@pytest.mark.parametrize("layout", ["rows", "columns"])
def test_onnx_detector_reads_both_layouts(layout):
    out = model_rows()
    det = DETECTORS.create("ONNX ", session=Session([(out if layout == "rows" else out.T)[None]]), names=["label", "tag"])
    found, ms = det.timed(np.zeros((320, 640, 3), np.uint8), 0.5)
    assert [(d.name, d.confidence, d.box, d.mask) for d in found] == [("label", 0.9, (270, 135, 370, 185), None), ("tag", 0.7, (600, 300, 640, 320), None)]
    assert ms.keys() == {"preprocess", "inference", "postprocess"} and min(ms.values()) >= 0
    assert det.detect(np.zeros((0, 0, 3), np.uint8)) == [] and det.detect(None) == []


def test_masks_and_the_two_caps():
    rows = np.zeros((100, 5 + 32))
    rows[0, :6] = [320, 320, 200, 200, 0.9, 5.0]
    rows[1, :5] = [100, 100, 40, 40, 0.8]
    rows[2, :5] = [321, 320, 200, 200, 0.85]
    protos = np.zeros((1, 32, 16, 16))
    protos[0, 0, :, :8] = 1
    run = lambda **k: E.onnx_detector(session=Session([rows[None], protos]), **k).detect(np.zeros((640, 640), np.uint8), 0.5)
    first = run()[0]
    assert first.mask.shape == (640, 640) and first.mask[320, 250] == 255 and first.mask[320, 400] == 0 and first.mask[10, 10] == 0
    assert [d.confidence for d in run(cap=2)] == [0.9, 0.8] and [d.confidence for d in run(cap=2, cap_candidates=True)] == [0.9]
    assert E.onnx_detector(session=Session([np.zeros((1, 84, 3))])).detect(np.zeros((9, 9, 3), np.uint8)) == []


def test_openvino_detector_and_its_tuning():
    det = DETECTORS.create("openvino", compiled=lambda tensor: {"a": model_rows()[None]}, names=["label", "tag"])
    assert det.cap_candidates and [d.box for d in det.detect(np.zeros((640, 640, 3), np.uint8), 0.5)] == [(270, 270, 370, 370), (600, 600, 640, 640)]
    got = E.compile_settings(threads=4, streams="auto", hint="latency", hyper_threading=False, pinning=None)
    assert got == {"INFERENCE_NUM_THREADS": "4", "PERFORMANCE_HINT": "LATENCY", "ENABLE_HYPER_THREADING": "NO"} and E.compile_settings(threads=0) == {}
    with pytest.raises(ValueError):
        E.compile_settings(cores=2)


def test_code_readers_take_the_code_that_counts():
    p = SimpleNamespace
    at = p(top_left=p(x=1, y=2), top_right=p(x=3, y=2), bottom_right=p(x=3, y=4), bottom_left=p(x=1, y=4))
    code = lambda text, valid: p(text=text, valid=valid, position=at)
    image = np.zeros((4, 4), np.uint8)
    read = lambda *r: CODE_READERS.create("zxing", read=lambda _: list(r)).read(image)
    assert read(code("a", False), code("", True), code("b", True)) == E.Code("", ((1, 2), (3, 2), (3, 4), (1, 4))) and read(code("a", False)) is None and read() is None
    read = lambda *t: CODE_READERS.create("wechat", read=lambda _: (t, [np.ones((4, 2)) * i for i in range(len(t))])).read(image)
    assert read("x", "y").text == "x" and read("", "y") is None and read() is None and read("x").polygon[0] == (0, 0)


def test_recogniser_flattens_pages_and_survives_errors():
    pages = [{"rec_texts": ["2/2", "M"], "rec_scores": [0.9], "rec_polys": [[[0, 1], [2, 1], [2, 3], [0, 3]]]}, {"rec_texts": None}]
    seen = []
    r = RECOGNISERS.create("paddle", read=lambda im: seen.append(im.shape) or pages)
    assert r.read(np.zeros((5, 6), np.uint8)) == [E.Block("2/2", 0.9, ((0.0, 1.0), (2.0, 1.0), (2.0, 3.0), (0.0, 3.0))), E.Block("M", 0.0, ())] and seen == [(5, 6, 3)]
    assert RECOGNISERS.create("paddle", read=lambda im: 1 / 0).read(np.zeros((5, 6), np.uint8)) == [] == RECOGNISERS.create("paddle", read=lambda im: None).read(np.zeros((5, 6), np.uint8))


def test_a_detector_runs_in_tasks(spark):
    rows = spark.createDataFrame([(k, 4, 6, 1, bytes(24)) for k in range(5)], "k int, h int, w int, c int, data binary")

    output = model_rows()[None]

    def build():
        det = E.ModelDetector(lambda t: [output], ["label", "tag"])

        def run(batch):
            return batch.assign(n=[len(det.detect(to_array(*x))) for x in zip(batch.h, batch.w, batch.c, batch.data)])[["k", "n"]]

        return run

    assert {(r.k, r.n) for r in with_model(rows, build, "k int, n int").collect()} == {(k, 2) for k in range(5)}


def test_candidates_in_either_layout(spark):
    rows = [[float(10 * i + j) for j in range(7)] for i in range(60)]
    turned = [list(c) for c in zip(*rows)]
    df = spark.createDataFrame([(1, rows), (2, turned), (3, [[1.0, 2.0]] * 60), (4, []), (5, None)], "k int, o array<array<double>>")
    got = {r.k: r.c for r in df.select("k", D.candidates(F.col("o"), 3).alias("c")).collect()}
    assert got[1] == got[2] and len(got[1]) == 60 and got[1][2].box == [20, 21, 22, 23] and got[1][2].scores == [24, 25, 26]
    assert got[3] == [] and got[4] == [] and got[5] is None
