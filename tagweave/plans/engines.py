"""Engines behind the registries: detectors, code readers and text recognisers around the native libraries that are installed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from tagweave.functions import pixels


@dataclass(frozen=True)
class Detection:
    name: str
    confidence: float
    box: tuple[int, int, int, int]
    mask: np.ndarray | None = None


@dataclass(frozen=True)
class Code:
    text: str
    polygon: tuple[tuple[int, int], ...]
    confidence: float = 1.0


@dataclass(frozen=True)
class Block:
    text: str
    confidence: float
    box: tuple[tuple[float, float], ...]


class Detector(Protocol):
    """What finds labels: an image (BGR) and a threshold to detections, greatest confidence first."""

    names: list[str]

    def detect(self, image: np.ndarray, threshold: float) -> list[Detection]: ...


class CodeReader(Protocol):
    """What reads codes: an image to the code that counts, None without one."""

    def read(self, image: np.ndarray) -> Code | None: ...


class Recogniser(Protocol):
    """What reads texts: an image to its text blocks."""

    def read(self, image: np.ndarray) -> list[Block]: ...


def turned(output: np.ndarray, n_classes: int, masks: int = 32, slack: int = 10) -> np.ndarray:
    """An output of two dimensions with its candidates as rows, whichever way it came (``operators.detect.rows_first`` on arrays)."""
    return output.T if output.shape[0] <= 4 + n_classes + masks + slack else output


def suppressed(boxes: np.ndarray, scores: np.ndarray, limit: float, cap: int, cap_candidates: bool) -> list[int]:
    """Indices of the boxes (corners) that greedy suppression keeps, by falling score; at most ``cap`` kept, or looked at."""
    order = np.argsort(-scores, kind="stable")
    if cap_candidates:
        order = order[:cap]
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    kept: list[int] = []
    for i in order:
        k = np.array(kept, int)
        w = np.maximum(0, np.minimum(boxes[k, 2], boxes[i, 2]) - np.maximum(boxes[k, 0], boxes[i, 0]))
        h = np.maximum(0, np.minimum(boxes[k, 3], boxes[i, 3]) - np.maximum(boxes[k, 1], boxes[i, 1]))
        union = area[k] + area[i] - w * h
        if not len(k) or not (np.divide(w * h, union, out=np.zeros(len(k)), where=union > 0) > limit).any():
            kept.append(int(i))
        if len(kept) == cap:
            break
    return kept


@dataclass
class ModelDetector:
    """A detector around a model's run: the tensor of an image to the model's outputs, the first the candidates, the second, if there is
    one, the mask prototypes. ``inner`` says how boxes are clipped (both corners within the image, or the outer bounds alone)."""

    run: Callable[[np.ndarray], list[np.ndarray]]
    names: list[str] = field(default_factory=lambda: ["label"])
    size: int = 640
    overlap: float = 0.45
    cap: int = 100
    cap_candidates: bool = False
    inner: bool = True

    def detect(self, image: np.ndarray, threshold: float = 0.5) -> list[Detection]:
        return self.timed(image, threshold)[0]

    def timed(self, image: np.ndarray, threshold: float = 0.5) -> tuple[list[Detection], dict[str, float]]:
        """Detections, and the milliseconds of preparing, running and decoding. An empty image has none."""
        if image is None or image.size == 0:
            return [], {"preprocess": 0.0, "inference": 0.0, "postprocess": 0.0}
        t = [time.perf_counter()]
        tensor = pixels.model_tensor(image, self.size)
        t.append(time.perf_counter())
        outputs = self.run(tensor)
        t.append(time.perf_counter())
        found = self.decode(outputs, image.shape[1], image.shape[0], threshold)
        t.append(time.perf_counter())
        return found, {k: (b - a) * 1000 for k, a, b in zip(("preprocess", "inference", "postprocess"), t, t[1:])}

    def decode(self, outputs: list[np.ndarray], width: int, height: int, threshold: float) -> list[Detection]:
        prototypes = outputs[1][0] if len(outputs) > 1 else None
        n, masks = len(self.names), 0 if prototypes is None else len(prototypes)
        rows = turned(np.asarray(outputs[0])[0], n).astype(np.float64)
        if rows.ndim != 2 or rows.shape[1] < 5 or not len(rows):
            return []
        scores = rows[:, 4 : 4 + n]
        kind, best = scores.argmax(1), scores.max(1)
        rows, kind, best = rows[best > threshold], kind[best > threshold], best[best > threshold]
        x, y, w, h = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]
        corners = np.trunc(np.stack([x - w / 2, y - h / 2, x + w / 2, y + h / 2], 1) * (np.array([width, height] * 2) / self.size)).astype(int)
        low = np.maximum(0, corners)
        boxes = np.concatenate([np.minimum(low[:, :2], [width - 1, height - 1]) if self.inner else low[:, :2], np.minimum(low[:, 2:] if self.inner else corners[:, 2:], [width, height])], 1)
        out = []
        for i in suppressed(boxes, best, self.overlap, self.cap, self.cap_candidates):
            box = tuple(int(v) for v in boxes[i])
            mask = pixels.decode_mask(rows[i, 4 + n : 4 + n + masks], prototypes, box, width, height) if masks and rows.shape[1] >= 4 + n + masks else None
            out.append(Detection(self.names[kind[i]] if kind[i] < n else "unknown", float(best[i]), box, mask))
        return out


def onnx_detector(path: str = "", threads: int = 0, **options: Any) -> ModelDetector:
    """Detector over an ONNX model file, or over a session made elsewhere (``session``)."""
    session = options.pop("session", None)
    if session is None:
        import onnxruntime

        settings = onnxruntime.SessionOptions()
        settings.intra_op_num_threads = threads
        session = onnxruntime.InferenceSession(path, settings, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return ModelDetector(lambda tensor: session.run(None, {name: tensor}), **options)


# Names of the compile settings of the OpenVINO runtime, by option.
_TUNING = {"threads": "INFERENCE_NUM_THREADS", "streams": "NUM_STREAMS", "hint": "PERFORMANCE_HINT", "hyper_threading": "ENABLE_HYPER_THREADING", "pinning": "ENABLE_CPU_PINNING"}


def compile_settings(**options: Any) -> dict[str, str]:
    """Compile settings of the runtime from ``threads, streams, hint, hyper_threading, pinning``; None, 0 threads and ``auto`` leave the
    runtime's own choice, switches are YES or NO, hints in capitals."""
    if unknown := options.keys() - _TUNING:
        raise ValueError(f"unknown tuning options {sorted(unknown)}")
    out = {}
    for k, v in options.items():
        if v is None or (k == "threads" and int(v) <= 0) or (isinstance(v, str) and v.strip().lower() == "auto"):
            continue
        out[_TUNING[k]] = ("YES" if v else "NO") if isinstance(v, bool) else str(v).upper()
    return out


def openvino_detector(path: str = "", device: str = "CPU", tuning: dict[str, Any] | None = None, **options: Any) -> ModelDetector:
    """Detector over a model of the OpenVINO runtime, or over a compiled one (``compiled``, called with a tensor)."""
    compiled = options.pop("compiled", None)
    if compiled is None:
        import openvino

        compiled = openvino.Core().compile_model(path, device, compile_settings(**(tuning or {})))
    return ModelDetector(lambda tensor: list(compiled(tensor).values()), **{"cap_candidates": True, "inner": False, **options})


def zxing_reader(rotate: bool = True, downscale: bool = True, read: Callable[..., Any] | None = None) -> CodeReader:
    """The first valid code of the ZXing library, even with an empty text."""
    if read is None:
        import zxingcpp

        read = lambda image: zxingcpp.read_barcodes(image, try_rotate=rotate, try_downscale=downscale)

    class Reader:
        def read(self, image: np.ndarray) -> Code | None:
            r = next((r for r in read(image) if r.valid), None)
            corners = r and (r.position.top_left, r.position.top_right, r.position.bottom_right, r.position.bottom_left)
            return r and Code(r.text, tuple((int(p.x), int(p.y)) for p in corners))

    return Reader()


def wechat_reader(model_dir: str = "models/wechat", read: Callable[..., Any] | None = None) -> CodeReader:
    """The first code with a text of the WeChat reader; none if its very first has none."""
    if read is None:
        import os

        import cv2

        files = [os.path.join(model_dir, f"{kind}.{suffix}") for kind in ("detect", "sr") for suffix in ("prototxt", "caffemodel")]
        read = cv2.wechat_qrcode_WeChatQRCode(*files).detectAndDecode

    class Reader:
        def read(self, image: np.ndarray) -> Code | None:
            texts, points = read(image)
            if not len(texts) or not texts[0]:
                return None
            return Code(texts[0], tuple((int(x), int(y)) for x, y in np.asarray(points[0])))

    return Reader()


def paddle_recogniser(read: Callable[..., Any] | None = None, **options: Any) -> Recogniser:
    """Text blocks of the PaddleOCR engine: gray images become colour; its parallel lists of texts, scores and polygons become blocks, a
    missing score 0 and a missing polygon empty; an engine that fails gives none."""
    if read is None:
        from paddleocr import PaddleOCR

        read = PaddleOCR(**options).predict

    class Reader:
        def read(self, image: np.ndarray) -> list[Block]:
            try:
                pages = list(read(pixels.colour(image)) or [])
            except Exception:  # errors are data
                return []
            out = []
            for page in pages:
                texts, scores, polygons = (list(page.get(k) if page.get(k) is not None else []) for k in ("rec_texts", "rec_scores", "rec_polys"))
                for i, text in enumerate(texts):
                    box = tuple((float(x), float(y)) for x, y in polygons[i]) if i < len(polygons) else ()
                    out.append(Block(text, float(scores[i]) if i < len(scores) else 0.0, box))
            return out

    return Reader()
