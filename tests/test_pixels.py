import zlib

import numpy as np
from pyspark.sql import functions as F

from tagweave.functions import pixels as X
from tagweave.operators import images as I
from tagweave.plans.plugins import CODE_READERS, DETECTORS, Registry
from tagweave.sources import sinks


def board(h=40, w=60):
    return ((np.arange(h)[:, None] * 5 + np.arange(w)[None, :] * 3) % 256).astype(np.uint8)


def test_resize_keeps_constant_images_and_shapes():
    flat = np.full((7, 9, 3), 93, np.uint8)
    for how in ("linear", "cubic", "area"):
        for size in ((3, 2), (9, 7), (20, 31)):
            out = X.resize(flat, *size, how)
            assert out.shape == (size[1], size[0], 3) and (out == 93).all()
    a = np.arange(16, dtype=np.uint8).reshape(4, 4) * 10
    assert (X.resize(a, 2, 2, "area") == np.array([[25, 45], [105, 125]])).all()
    assert (X.resize(a, 4, 4) == a).all()


def test_scale_for_code():
    image, f = X.scale_for_code(board(40, 320), 640)
    assert image.shape == (80, 640) and f == 2.0
    same = board(10, 637)
    assert X.scale_for_code(same, 640)[0] is same
    assert X.scale_for_code(np.zeros((0, 0), np.uint8), 640)[1] == 1.0


def test_enhancement():
    a = board()
    assert X.clahe(a).shape == a.shape and X.clahe(np.zeros((5, 5, 3), np.uint8)).ndim == 3
    flat = np.full((32, 32), 100, np.uint8)
    assert len(np.unique(X.clahe(flat))) == 1
    assert (X.unsharp(flat) == 100).all() and X.clahe(a).std() > 0
    edge = np.repeat(np.array([[50] * 10 + [200] * 10], np.uint8), 20, 0)
    assert X.unsharp(edge)[10, 9] < 50 and X.unsharp(edge)[10, 10] > 200
    noisy = np.full((9, 9), 10, np.uint8)
    noisy[4, 4] = 255
    assert (X.median3(noisy) == 10).all()
    out, bright, sharp = X.enhance(np.dstack([a] * 3), True, False)
    assert out.ndim == 2 and (bright, sharp) == (True, False)


def test_contours_and_least_rectangle():
    mask = np.zeros((30, 40), np.uint8)
    mask[5:15, 10:30] = 255
    mask[20:22, 2:4] = 255
    c = X.largest_contour(mask)
    assert {tuple(p) for p in c} == {(10, 5), (29, 5), (29, 14), (10, 14)}
    assert len(X.outer_contours(mask)) == 2 and X.largest_contour(np.zeros((3, 3))) is None
    assert len(X.outer_contours(np.array([[0, 0, 0], [0, 1, 0], [0, 0, 0]]))[0]) == 1
    s = 100 * np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])
    assert abs(X.polygon_area(X.ordered(X.least_rectangle(s))) - 20000) < 1e-6


def test_crop_rotated():
    image = board(60, 80)
    out, said = X.crop_rotated(image, np.array([[10, 5], [49, 5], [49, 24], [10, 24]]))
    assert said == "Success: 39x19" and abs(out.astype(int)[0, 0] - image[5, 10]) <= 1
    assert X.crop_rotated(image, np.array([[1, 1], [2, 2]]))[0] is None
    assert X.crop_rotated(image, np.array([[1, 1], [1, 1], [1, 1]]))[0] is None
    assert X.landscape(image.T).shape == (60, 80) and X.landscape(image) is image


def test_model_side_kernels():
    t = X.model_tensor(board(), 32)
    assert t.shape == (1, 3, 32, 32) and t.dtype == np.float32 and t.max() <= 1
    m = X.decode_mask(np.array([1.0, -1.0]), np.stack([np.full((8, 8), 5.0), np.zeros((8, 8))]), (2, 3, 10, 12), 16, 16)
    assert m[3:12, 2:10].all() and m.sum() == 255 * 9 * 8
    assert X.ctc_decode(np.eye(4)[[0, 1, 1, 0, 2, 3, 3]], ["a", "b", "c"]) == ("abc", 1.0) and X.ctc_decode(np.eye(2)[[0, 0]], ["a"]) == ("", 0.0)


def test_merge_and_masked_crop():
    merged = X.merge_regions(np.zeros((53, 149), np.uint8), np.zeros((221, 505), np.uint8), 1.0)
    assert merged.shape == (277, 505) and (merged[53:56] == 128).all() and merged[0, 0] == 255 and merged[0, 252] == 0
    mask = np.zeros((5, 5), np.uint8)
    mask[1, 1] = 1
    assert X.masked_crop(np.full((5, 5, 3), 9, np.uint8), mask, (0, 0, 3, 3)).sum() == 27


def test_png_bytes():
    a = board(3, 4)
    data = X.png_encode(a)
    at = data.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(data[at + 4 :]), np.uint8).reshape(3, 5)
    assert (raw[:, 1:] == a).all() and data.startswith(b"\x89PNG")


def image_rows(spark):
    rows = [("a", I.to_row(board())), ("b", None), ("c", {"h": 5, "w": 5, "c": 1, "data": b"xx"}), ("d", {"h": 0, "w": 0, "c": 1, "data": b""})]
    return spark.createDataFrame([(k, tuple(v.values()) if v else None) for k, v in rows], f"k string, image {I.IMAGE.simpleString()}")


def test_kernels_on_columns_turn_bad_images_into_null(spark):
    df = image_rows(spark)
    got = {r.k: r.x for r in df.select("k", I.kernel(X.landscape)(F.col("image")).alias("x")).collect()}
    assert (got["a"].h, got["a"].w) == (40, 60) and got["b"] is None and got["c"] is None and got["d"] is None
    assert df.where("false").select(I.kernel(X.gray)(F.col("image"))).count() == 0


def test_write_and_read_images(spark, tmp_path):
    from tagweave.sources import files

    done = {r.name: r.written for r in sinks.write_images(image_rows(spark), "k", "image", str(tmp_path / "out/x")).collect()}
    assert done == {"a": True, "b": False, "c": False, "d": False}
    (tmp_path / "out/x/broken.PNG").write_bytes(b"no image")
    (tmp_path / "out/x/mixed.Png").write_bytes(b"no suffix of ours")
    (tmp_path / "out/note.txt").write_text("x")
    found = files.image_files(spark, str(tmp_path / "out")).select("path", "frame_id").collect()
    assert [r.frame_id for r in found] == ["x_a", "x_broken"] and files.image_files(spark, str(tmp_path / "out"), 1).count() == 1
    images = {r.path.rsplit("/", 1)[1]: r for r in files.decoded_images(spark, str(tmp_path / "out/x")).collect()}
    assert (images["a.png"].image.h, images["a.png"].image.w, images["a.png"].error) == (40, 60, None)
    assert images["broken.PNG"].image is None and images["broken.PNG"].error == "Failed to read image"
    copies = sinks.copy_files(spark.createDataFrame([(str(tmp_path / "out/x/a.png"), str(tmp_path / "err/b/a.png")), (str(tmp_path / "none.png"), str(tmp_path / "err/n.png"))], "s string, t string"), "s", "t")
    assert sorted(r.copied for r in copies.collect()) == [False, True] and (tmp_path / "err/b/a.png").exists()


def test_model_is_built_once_a_task(spark):
    def build():
        made = [0]

        def model(batch):
            made[0] += 1
            return batch.assign(n=made[0])

        return model

    out = I.with_model(spark.range(10).coalesce(1), build, "id long, n long").collect()
    assert {r.n for r in out} == {1}
    assert I.by_shape(spark.range(10), F.col("id"), F.lit(2), 3).rdd.getNumPartitions() == 3


def test_registries():
    assert CODE_READERS.names() == ["wechat", "zxing"] and DETECTORS.names() == ["onnx", "openvino"]
    r = Registry("thing")
    r.register(" One ", lambda x=1: x)
    assert r.create("ONE", x=5) == 5 and r.available("one") and not r.available("two")
    r.register("bad", lambda: 1, lambda: 1 / 0)
    assert not r.available("bad")
    try:
        r.create("two")
    except ValueError as e:
        assert "one" in str(e)
    else:
        raise AssertionError


def test_code_and_orientation_steps():
    image = board(40, 320)
    assert X.prepare_for_code(image, False)[1] == 1.0 and X.prepare_for_code(None) == (None, 1.0)
    minimal, full, unknown = (X.prepare_for_code(image, True, m, 640)[0] for m in ("minimal", "full", "other"))
    assert minimal.shape == (80, 640) and (full == unknown).all()
    seen = []
    flip = lambda v: seen.append(v.shape) or ("180_degree", 0.9)
    out, turned = X.fix_orientation(board(20, 2000), flip)
    assert turned and seen == [(10, 1000)] and (out == board(20, 2000)[::-1, ::-1]).all()
    assert not X.fix_orientation(image, lambda v: ("90_degree", 0.99))[1] and not X.fix_orientation(image, lambda v: ("180", 0.6))[1]
    box = np.array([[2, 2], [12, 2], [12, 32], [2, 32]])
    out, said = X.preprocess(board(40, 60), box, classify=lambda v: ("0", 1.0))
    assert out.shape[1] > out.shape[0] and said == "Success: 10x30 | Rotated to landscape | Orientation kept"
    assert X.preprocess(None, box) == (None, "No image") and X.preprocess(board(), None)[0] is None


def test_text_model_kernels():
    assert X.detection_tensor(board(), 16).shape == (1, 3, 16, 16)
    t = X.recognition_tensor(np.full((24, 48), 255, np.uint8), 10)
    assert t.shape == (3, 48, 320) and (t[:, :, :96] == 1).all() and (t[:, :, 96:] == 0).all()
    scores = np.zeros((20, 30))
    scores[3:10, 4:20], scores[15, 2] = 0.9, 0.9
    boxes = X.text_boxes(scores)
    assert len(boxes) == 1 and boxes[0].tolist() == [[4, 3], [19, 3], [19, 9], [4, 9]]
    assert X.prepare_frame(board(640, 2560)).shape == (320, 1280) and (X.prepare_frame(board(), True) == board()[:, ::-1]).all()


def test_drawing():
    mask = np.zeros((4, 4), np.uint8)
    mask[0, 0] = 1
    assert X.overlay(np.zeros((4, 4), np.uint8), mask, (100, 200, 50), 0.5)[0, 0].tolist() == [50, 100, 25]
    drawn = X.outline(np.zeros((9, 9), np.uint8), (-3, 2, 7, 8), (1, 1, 1), 1)
    assert drawn[2, 0:7].all() and drawn[7, 0:7].all() and not drawn[4, 2].any() and drawn[4, 6].all()


def test_micro_batches_keep_order():
    sizes = []
    model = I.in_micro_batches(lambda xs: sizes.append(len(xs)) or [x.shape[1] for x in xs], 6)
    images = [np.zeros((10, w), np.uint8) for w in (50, 3, 20, 7, 90, 1, 2, 8)]
    assert model(images) == [50, 3, 20, 7, 90, 1, 2, 8] and sizes == [6, 2] and model([]) == []
