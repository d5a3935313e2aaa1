import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F
from test_operations import T0, expected_samples, frames

from tagweave.sources import camera, config, files
from tagweave.streaming import frames as S


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"a": {"b": None, "c": False, "d": 0, "e": {"f": 1}}, "s7_ocr": {"cpuThreads": 2, "other": 1}, "s5_qr_detection": {"preprocessing": {"enabled": True}}, "app": 3}))
    s = config.load(str(p))
    assert [config.get(s, k, "x") for k in ("a.b", "a.c", "a.d", "a.e.f", "a.c.z", "q")] == ["x", False, 0, 1, "x", "x"]
    assert config.section(s, "s7_ocr").cpuThreads == 2 and config.section({}, "s7_ocr").cpuThreads == 8
    assert config.section(s, "s5_qr_detection").preprocessing == {"enabled": True, "mode": "full", "targetWidth": 480} and config.section(s, "app").jpegQuality == 95
    assert set(config.typed({})) >= {"app", "debug", "s2_detection"} and config.load(str(tmp_path / "none.json")) == {}
    p.write_text("[1]")
    assert config.load(str(p)) == {}


def test_json_sources(spark, tmp_path):
    d = str(tmp_path)
    assert files.dictionary(spark, f"{d}/none.json").count() == 0 and files.detection_logs(spark, d).count() == 0 and files.batch_summaries(spark, d).count() == 0
    (tmp_path / "sizes.json").write_text(json.dumps([{"name": " m "}, {"name": "XL", "path": "p"}, {"name": ""}, {"other": 1}, {"name": "M"}]))
    assert [(r.entry, r.ord) for r in files.dictionary(spark, f"{d}/sizes.json").orderBy("ord").collect()] == [("M", 1), ("XL", 2)]
    (tmp_path / "detection_1.json").write_text(json.dumps({"frameId": "f", "numDetections": 1, "detections": [{"className": "label", "confidence": 0.9, "bbox": [1, 2, 3, 4], "hasMask": True}]}))
    (tmp_path / "detection_2.json").write_text("{broken")
    assert [r.frameId for r in files.detection_logs(spark, d).collect() if r.frameId] == ["f"]
    (tmp_path / "batch_summary_a.json").write_text(json.dumps({"batch_info": {"total_images": 2}, "individual_results": [{"frameId": "f", "success": False, "total_ms": 1.0, "error": "No QR code detected"}, {"frameId": "g", "success": True}]}))
    got = files.batch_results(files.batch_summaries(spark, d)).orderBy("frame_id").collect()
    assert [(r.batch, r.frame_id, r.success, r.error) for r in got] == [("batch_summary_a", "f", False, "No QR code detected"), ("batch_summary_a", "g", True, None)]


def test_cameras():
    camera.DEVICES["broken"] = lambda *a: 1 / 0
    assert [c["index"] for c in camera.list_cameras("pattern", 2)] == [0, 1] and camera.list_cameras("broken") == []
    assert camera.capture_id(dt.datetime(2020, 1, 2, 3, 4, 5, 67999)) == "frame_20200102_030405_067"


def wait(query, rows, seconds=60):
    end = time.time() + seconds
    while time.time() < end and query.exception() is None:
        got = rows()
        if got:
            return got
        time.sleep(0.5)
    raise AssertionError(query.exception() or "no rows")


def test_camera_stream(spark, tmp_path):
    spark.dataSource.register(camera.CameraSource)
    df = spark.readStream.format("label_camera").option("width", 8).option("height", 6).load()
    q = df.writeStream.format("memory").queryName("cam").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        row = wait(q, lambda: spark.table("cam").collect())[0]
        assert row.success and (row.h, row.w, row.c, len(row.data)) == (6, 8, 1, 48) and row.frame_id.startswith("frame_")
    finally:
        q.stop()


def test_stream_samples_equal_batch(spark, tmp_path):
    rows = sorted(r for r in set(frames(7)) if None not in r)
    rows.sort(key=lambda r: r[2])
    src = tmp_path / "in"
    src.mkdir()
    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        (src / f"{i}.json").write_text("\n".join(json.dumps({"cam": a, "f": b, "t": c.isoformat(), "ok": d}) for a, b, c, d in part))
        time.sleep(0.02)
    stream = spark.readStream.schema("cam string, f string, t timestamp, ok boolean").option("maxFilesPerTrigger", 1).json(str(src))
    out = S.cooldown_stream(stream, "cam", "f", "t", F.col("ok"), 2.0)
    q = out.writeStream.format("memory").queryName("cool").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [(r.cam, r.f) for r in spark.table("cool").collect()]
    assert set(got) == expected_samples(rows)


def test_stream_helpers(spark, tmp_path):
    assert S.trigger_ms(60) == 16 and S.trigger_ms(5000) == 1
    df = spark.createDataFrame([("a", 1, T0), ("a", 2, T0 + dt.timedelta(1)), ("b", 3, T0)], "e string, i int, t timestamp_ntz")
    assert sorted(r.i for r in S.latest_only(df, "e", "t").collect()) == [2, 3]
    d = spark.createDataFrame([([1], "x"), ([], "y"), (None, "z")], "d array<int>, l string")
    assert [r.label for r in S.clear_on_empty(d, "d", F.col("l")).collect()] == ["x", None, None]
    runs = []

    def start(settings):
        runs.append(settings)
        return spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "r")).start()

    c = S.Controls(start, detection=True, threshold=0.5)
    try:
        c.run()
        c.change(threshold=0.5)
        assert len(runs) == 1
        c.change(threshold=0.7)
        assert runs[-1] == {"detection": True, "threshold": 0.7} and c.query.isActive
    finally:
        c.stop()


@pytest.mark.parametrize("name", ["entry", "queries"])
def test_contract(spark, name):
    import __spark_entry__ as e

    if name == "entry":
        assert e.entry(spark).count() > 0
    else:
        q, o = e.queries(), e.oracle_sql()
        assert len(q) > 60 and set(o) <= set(q) and {"p2_found", "p3_found"} <= set(q)


def test_camera_skips_its_first_frames_and_keeps_the_target_rate():
    import time

    from tagweave.sources.camera import _Reader

    plain, slow = _Reader({"width": "4", "height": "4"}), _Reader({"width": "4", "height": "4", "fps": "20", "skip_first_frames": "3"})
    first = lambda reader: next(reader.read({"n": 0})[0])[5][0]
    assert [first(plain), first(plain)] == [1, 2]
    began = time.perf_counter()
    assert [first(slow) for _ in range(5)] == [4, 5, 6, 7, 8]
    assert time.perf_counter() - began >= 4 / 20
