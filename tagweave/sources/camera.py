"""A camera as a Python data source for Structured Streaming: newest frame only, ids from the capture time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

_SCHEMA = "frame_id STRING, ts TIMESTAMP, h INT, w INT, c INT, data BINARY, success BOOLEAN, ms DOUBLE"


class PatternDevice:
    """A device without hardware: a gray gradient that moves with every frame."""

    def __init__(self, index: int, width: int, height: int) -> None:
        self.index, self.width, self.height, self.n = index, width, height, 0

    def read(self) -> np.ndarray | None:
        self.n += 1
        return ((np.arange(self.height)[:, None] + np.arange(self.width)[None, :] + self.n) % 256).astype(np.uint8)

    def close(self) -> None:
        pass


#: Devices by name: ``open(index, width, height)`` gives an object with ``read`` and ``close``, or raises.
DEVICES: dict[str, Callable[..., object]] = {"pattern": PatternDevice}


def list_cameras(device: str = "pattern", most: int = 2) -> list[dict]:
    """The indices below ``most`` whose device opens and gives a frame."""
    found = []
    for i in range(most):
        try:
            camera = DEVICES[device](i, 64, 64)
        except Exception:
            continue
        if camera.read() is not None:
            found.append({"index": i, "name": f"Camera {i}"})
        camera.close()
    return found


def capture_id(at: datetime) -> str:
    return f"frame_{at:%Y%m%d_%H%M%S}_{at.microsecond // 1000:03d}"


class _Reader(SimpleDataSourceStreamReader):
    """Each batch is the newest frame; what came since the last one is dropped, as with a device buffer of one."""

    def __init__(self, options: dict) -> None:
        self.open = lambda: DEVICES[options.get("device", "pattern")](int(options.get("index", 0)), int(options.get("width", 640)), int(options.get("height", 640)))
        self.skip, self.pause, self.next = int(options.get("skip_first_frames", 0)), 1 / float(options["fps"]) if float(options.get("fps", 0)) > 0 else 0.0, 0.0
        self.camera = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.camera is None:
            self.camera = self.open()
            for _ in range(self.skip):
                self.camera.read()
        time.sleep(max(0.0, self.next - time.perf_counter()))
        began = time.perf_counter()
        self.next = began + self.pause
        at, image = datetime.now(timezone.utc), self.camera.read()
        ms = (time.perf_counter() - began) * 1000
        ok = image is not None
        shape = (image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], image.tobytes()) if ok else (None, None, None, None)
        return iter([(capture_id(at), at, *shape, ok, ms)]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        # A live frame can't be captured again; after a failure the batch is taken as lost.
        return iter([])

    def commit(self, end: dict) -> None:
        pass


class CameraSource(DataSource):
    """``spark.dataSource.register(CameraSource)``, then ``spark.readStream.format("label_camera")`` with the options ``device``,
    ``index``, ``width``, ``height``, ``fps`` (frames a second at most; 0, the default, for no limit) and ``skip_first_frames``."""

    @classmethod
    def name(cls) -> str:
        return "label_camera"

    def schema(self) -> str:
        return _SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))


