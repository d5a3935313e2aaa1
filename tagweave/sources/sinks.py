"""Sinks: stage records as JSON, batch summaries, images, and copies of error images."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions import pixels
from tagweave.operators import metrics as M
from tagweave.operators.images import to_array

_STAGES = ("s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8")


@dataclass(frozen=True)
class DebugSwitch:
    """One switch for the side outputs of all stages; a stage's folder exists only once something is written."""

    base: str
    enabled: bool = False

    def folder(self, stage: str) -> str | None:
        if stage not in _STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        return f"{self.base}/{stage}" if self.enabled else None


def stage_record(stage: str, frame: Column, **fields: Column) -> Column:
    """A stage's record as JSON text, ``frameId`` first; null fields are written as null."""
    return F.to_json(F.struct(frame.alias("frameId"), *[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


#: Columns that each stage's record takes from its rows, by the record's field (fixed names).
RECORD_FIELDS = {
    "s3": {"rotationAngle": "rotation_angle", "orientationFixed": "orientation_fixed", "imageShape": "image_shape", "contourPointsCount": "contour_points"},
    "s4": {"brightnessApplied": "brightness_applied", "sharpnessApplied": "sharpness_applied", "imageShape": "image_shape"},
    "s5": {"text": "text", "polygon": "polygon", "rect": "rect", "confidence": "confidence", "backend": "backend", "preprocessingEnabled": "preprocessing_enabled", "preprocessingMode": "preprocessing_mode", "parsed": "parsed"},
    "s6": {"mergedImageShape": "merged_shape", "aboveQrRoiShape": "above_shape", "belowQrRoiShape": "below_shape"},
    "s7": {"textBlocks": "text_blocks"},
    "s8": {"labelData": "label_data", "processingTimeMs": "processing_time_ms"},
}


def record_of(stage: str, frame: Column, **given: Column) -> Column:
    """The JSON record of stage ``s3`` to ``s8``: its fields in their order, from the columns given by the names of ``RECORD_FIELDS``; a
    missing one is an error, a null one is written as null. ``contour_points`` is the points' array, of which the number is written."""
    fields = RECORD_FIELDS[stage]
    if set(given) != set(fields.values()):
        raise ValueError(f"stage {stage} takes {sorted(fields.values())}")
    count = lambda c: F.greatest(F.size(c), F.lit(0))
    return stage_record(stage, frame, **{k: count(given[c]) if c == "contour_points" else given[c] for k, c in fields.items()})


def write_records(rows: DataFrame, debug: DebugSwitch, stage: str) -> bool:
    """Writes a stage's rows as JSON lines below its folder; nothing if the switch is off. Returns whether it wrote."""
    if (folder := debug.folder(stage)) is None:
        return False
    rows.write.mode("append").json(folder)
    return True


def frame_timing(frame: Column, ts: Column, timing: Column) -> Column:
    """Timing record of a frame: the stages' times, their total and the frames a second (two places, 0 without time)."""
    total = F.coalesce(timing["total"], F.aggregate(F.map_values(timing), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))))
    fps = F.when(total > 0, F.round(1000 / total, 2)).otherwise(0.0)
    return F.struct(frame.alias("frameId"), ts.cast("string").alias("timestamp"), timing.alias("timing_ms"), F.struct(total.alias("total_ms"), fps.alias("fps")).alias("summary"))


def batch_report(results: DataFrame, batch: str, frame: str, success: Column, timing: Column, error: Column) -> DataFrame:
    """One row per batch in the shape of a batch summary: ``batch, batch_info, timing_summary, step_averages_ms``. The single results
    stay rows of their own table (``results``), so no row grows with its batch."""
    s = M.batch_summary(results, [F.col(batch)], success, timing)
    steps = results.select(F.col(batch).alias("__b"), F.explode(timing).alias("stage", "ms")).groupBy("__b", "stage").agg(F.avg("ms").alias("ms"))
    steps = steps.groupBy("__b").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("step_averages_ms"))
    total = results.groupBy(F.col(batch).alias("__t")).agg(F.sum(timing["total"]).alias("batch_total_ms"))
    out = s.join(steps, s[batch].eqNullSafe(steps["__b"]), "left").join(total, s[batch].eqNullSafe(total["__t"]), "left")
    return out.select(
        batch,
        F.struct(F.col("total").alias("total_images"), "successful", "failed", "success_rate").alias("batch_info"),
        F.struct(F.coalesce("batch_total_ms", F.lit(0.0)).alias("batch_total_ms"), F.col("avg_ms").alias("avg_per_image_ms"), F.col("min_ms").alias("min_image_ms"), F.col("max_ms").alias("max_image_ms"), "avg_fps").alias("timing_summary"),
        "step_averages_ms",
    )


def _shared(rows: DataFrame, path: str) -> None:
    """An error for a path of one machine where the tasks run on several."""
    if "://" not in path and not rows.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{path!r} is a path of each machine's own; name a shared file system (file://, hdfs://, s3:// ...)")


def _encoded(image: np.ndarray, suffix: str, quality: int) -> bytes:
    """The image as a file of its suffix: PNG by the kernel of our own (compression 3), JPEG by whichever image library is installed."""
    if suffix == "png":
        return pixels.png_encode(image)
    if suffix not in ("jpg", "jpeg"):
        raise ValueError(f"no encoder for .{suffix}")
    try:
        import cv2

        done, data = cv2.imencode(".jpg", image, [cv2.IMWRITE_JPEG_QUALITY, quality])
        if not done:
            raise ValueError("image not encoded")
        return data.tobytes()
    except ModuleNotFoundError:
        import io

        from PIL import Image

        out = io.BytesIO()
        Image.fromarray(image if image.ndim == 2 else image[:, :, ::-1]).save(out, "JPEG", quality=quality)
        return out.getvalue()


def write_images(rows: DataFrame, name: str, image: str, folder: str, suffix: str = "png", quality: int = 95) -> DataFrame:
    """Writes every image as ``<folder>/<name>.<suffix>`` (PNG, or JPEG of ``quality`` where an image library is installed) on the executors,
    making folders as needed; ``name, written``. ``folder`` may be on any file system that Arrow knows by its URI; on a cluster it
    must be, as a plain path is each machine's own.

    Lazy like any plan: the files are there once the result has been read. A null or broken image isn't written. A task that is
    run again writes the same files again."""
    _shared(rows, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        for batch in batches:
            done = []
            for n, im in zip(batch["name"], batch["image"]):
                try:
                    path = f"{base}/{n}.{suffix}"
                    data = _encoded(to_array(im["h"], im["w"], im["c"], im["data"]), suffix, quality)
                    system.create_dir(os.path.dirname(path), recursive=True)
                    with system.open_output_stream(f"{path}.part") as f:
                        f.write(data)
                    system.move(f"{path}.part", path)
                    done.append(True)
                except Exception:  # errors are data
                    done.append(False)
            yield pd.DataFrame({"name": batch["name"], "written": done})

    return rows.select(F.col(name).cast("string").alias("name"), F.col(image).alias("image")).mapInPandas(run, "name STRING, written BOOLEAN")


def write_stage_images(rows: DataFrame, debug: DebugSwitch, stage: str, frame: str, image: str, prefix: str = "") -> DataFrame | None:
    """``write_images`` of a stage's images as ``<stage folder>/<prefix>_<frame>.png``; None if the switch is off."""
    if (folder := debug.folder(stage)) is None:
        return None
    name = F.concat(F.lit(f"{prefix}_" if prefix else ""), F.col(frame).cast("string"))
    return write_images(rows.select(name.alias("name"), F.col(image).alias("image")), "name", "image", folder)


def copy_files(files: DataFrame, source: str, target: str) -> DataFrame:
    """Copies the file in column ``source`` to the path in ``target`` on the executors: ``source, target, copied``. Paths are URIs of any file
    system that Arrow knows, or plain ones where all tasks run on this machine."""
    local = files.sparkSession.sparkContext.master.startswith("local")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for a, b in zip(batch["source"], batch["target"]):
                try:
                    if not local and not ("://" in a and "://" in b):
                        raise ValueError("plain paths are each machine's own")
                    there, to = (fs.FileSystem.from_uri(p if "://" in p else os.path.abspath(p)) for p in (a, b))
                    to[0].create_dir(os.path.dirname(to[1]), recursive=True)
                    fs.copy_files(there[1], to[1], source_filesystem=there[0], destination_filesystem=to[0])
                    done.append(True)
                except Exception:  # errors are data
                    done.append(False)
            yield batch.assign(copied=done)

    return files.select(F.col(source).alias("source"), F.col(target).alias("target")).mapInPandas(run, "source STRING, target STRING, copied BOOLEAN")
