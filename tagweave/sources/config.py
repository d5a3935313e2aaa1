"""Application settings: JSON file, dotted access, and typed defaults per stage."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def load(path: str) -> dict[str, Any]:
    """The JSON object of a settings file; empty if the file is missing, unreadable or no object."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def get(settings: dict[str, Any], key: str, default: Any = None) -> Any:
    """The value at a dotted key; ``default`` where a part is missing or null. False and 0 are values."""
    at: Any = settings
    for part in key.split("."):
        at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            return default
    return at


def json_get(settings: Column, key: str, default: str) -> Column:
    """``get`` over a column of settings as JSON texts, the value as text; ``default`` too where the text is null or no JSON."""
    return F.coalesce(F.get_json_object(settings, f"$.{key}"), F.lit(default))


# The defaults of the settings where a file doesn't give them, by section.


@dataclass(frozen=True)
class App:
    captureDirectory: str = "output/captures"
    jpegQuality: int = 95
    windowMinWidth: int = 1000
    windowMinHeight: int = 700


@dataclass(frozen=True)
class Debug:
    enabled: bool = False
    basePath: str = "output/debug"
    saveCooldown: float = 2.0
    performanceLogging: dict = field(default_factory=lambda: {"enabled": True, "logInterval": 1, "showInStatusBar": True})


@dataclass(frozen=True)
class Camera:
    frameWidth: int = 640
    frameHeight: int = 640
    fps: int = 60
    maxCameraSearch: int = 2


@dataclass(frozen=True)
class Detection:
    modelPath: str | None = None
    backend: str = "onnx"
    isSegmentation: bool = True
    inputSize: int = 640
    confidenceThreshold: float = 0.5
    maxAreaRatio: float = 0.40
    topNDetections: int = 1
    visualization: dict = field(default_factory=lambda: {"boxColor": [0, 255, 0], "textColor": [0, 0, 0], "lineThickness": 2, "fontSize": 0.8, "maskOpacity": 0.4, "maskColors": []})


@dataclass(frozen=True)
class Preprocessing:
    enabled: bool = True
    forceLandscape: bool = True
    aiOrientationFix: bool = True
    aiConfidenceThreshold: float = 0.6
    paddleModelPath: str | None = None
    displayWidth: int = 230
    displayHeight: int = 100
    orientationCpuThreads: int = 4
    orientationEnableMkldnn: bool = True


@dataclass(frozen=True)
class Enhancement:
    brightnessEnabled: bool = True
    brightnessClipLimit: float = 2.5
    brightnessTileSize: int = 8
    sharpnessEnabled: bool = True
    sharpnessSigma: float = 1.0
    sharpnessAmount: float = 1.5


@dataclass(frozen=True)
class CodeReading:
    enabled: bool = True
    backend: str = "zxing"
    zxing: dict = field(default_factory=lambda: {"tryRotate": True, "tryDownscale": True})
    wechat: dict = field(default_factory=lambda: {"modelDir": "models/wechat"})
    preprocessing: dict = field(default_factory=lambda: {"enabled": False, "mode": "full", "targetWidth": 480})


@dataclass(frozen=True)
class Components:
    aboveQrWidthRatio: float = 0.35
    aboveQrHeightRatio: float = 0.20
    belowQrWidthRatio: float = 0.65
    belowQrHeightRatio: float = 0.45
    padding: int = 5
    aboveQrScaleFactor: float = 2.0
    grayscalePreprocessing: bool = False


@dataclass(frozen=True)
class Recognition:
    enabled: bool = True
    lang: str = "en"
    useTextlineOrientation: bool = False
    textDetThresh: float = 0.15
    textDetBoxThresh: float = 0.15
    textRecScoreThresh: float = 0.3
    device: str = "cpu"
    textDetectionModelName: str | None = None
    textRecognitionModelName: str | None = None
    precision: str = "fp32"
    enableMkldnn: bool = True
    mkldnnCacheCapacity: int = 10
    cpuThreads: int = 8
    textDetLimitType: str = "min"
    textDetLimitSideLen: int = 736
    textDetUnclipRatio: float = 1.5


@dataclass(frozen=True)
class Postprocessing:
    minFuzzyScore: float = 0.90
    productsJsonPath: str | None = None
    sizesJsonPath: str | None = None
    colorsJsonPath: str | None = None


_SECTIONS = {
    "app": App, "debug": Debug, "s1_camera": Camera, "s2_detection": Detection, "s3_preprocessing": Preprocessing, "s4_enhancement": Enhancement,
    "s5_qr_detection": CodeReading, "s6_component_extraction": Components, "s7_ocr": Recognition, "s8_postprocessing": Postprocessing,
}


def section(settings: dict[str, Any], name: str) -> Any:
    """A section with its defaults filled in; inner objects are filled key by key, unknown keys are ignored, wrong sections are all defaults."""
    given = settings.get(name)
    given = given if isinstance(given, dict) else {}
    kind, values = _SECTIONS[name], {}
    for f in fields(kind):
        value = given.get(f.name)
        if isinstance(default := getattr(kind(), f.name), dict):
            value = {k: v if (x := get(given, f"{f.name}.{k}")) is None else x for k, v in default.items()}
        if value is not None:
            values[f.name] = value
    return kind(**values)


def typed(settings: dict[str, Any]) -> dict[str, Any]:
    """All sections by name."""
    return {name: section(settings, name) for name in _SECTIONS}
