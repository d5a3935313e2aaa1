"""Extension points: registries of detectors, code readers and text recognisers, by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

from tagweave.plans import engines

X = TypeVar("X")


class Registry(Generic[X]):
    """Factories by name (trimmed, small letters). A factory is called once a task by ``operators.images.with_model``."""

    def __init__(self, what: str) -> None:
        self.what = what
        self._made: dict[str, tuple[Callable[..., X], Callable[[], bool]]] = {}

    def register(self, name: str, factory: Callable[..., X], available: Callable[[], bool] = lambda: True) -> None:
        self._made[name.strip().lower()] = (factory, available)

    def names(self) -> list[str]:
        return sorted(self._made)

    def available(self, name: str) -> bool:
        """Whether the name is known and its engine can be loaded here; never raises."""
        try:
            return bool(self._made[name.strip().lower()][1]())
        except Exception:
            return False

    def create(self, name: str, **options: object) -> X:
        key = name.strip().lower()
        if key not in self._made:
            raise ValueError(f"unknown {self.what} {name!r}; known: {', '.join(self.names())}")
        return self._made[key][0](**options)


def _importable(module: str) -> Callable[[], bool]:
    def check() -> bool:
        import importlib.util

        return importlib.util.find_spec(module) is not None

    return check


DETECTORS: Registry[engines.Detector] = Registry("detector")
CODE_READERS: Registry[engines.CodeReader] = Registry("code reader")
RECOGNISERS: Registry[engines.Recogniser] = Registry("text recogniser")
DETECTORS.register("onnx", engines.onnx_detector, _importable("onnxruntime"))
DETECTORS.register("openvino", engines.openvino_detector, _importable("openvino"))
CODE_READERS.register("zxing", engines.zxing_reader, _importable("zxingcpp"))
CODE_READERS.register("wechat", engines.wechat_reader, _importable("cv2"))
RECOGNISERS.register("paddle", engines.paddle_recogniser, _importable("paddleocr"))
