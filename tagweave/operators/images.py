"""Image columns (``STRUCT<h INT, w INT, c INT, data BINARY>``) through pixel kernels and models, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.runtime import let

IMAGE = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("data", T.BinaryType())])


def to_array(h: int, w: int, c: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return a.reshape(h, w) if c == 1 else a.reshape(h, w, c)


def to_row(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "c": 1 if a.ndim == 2 else a.shape[2], "data": np.ascontiguousarray(a, np.uint8).tobytes()}


def from_files(files: DataFrame) -> Column:
    """Image of Spark's ``image`` source column, null for unreadable files."""
    return F.when(F.col("image.height") > 0, F.struct(F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data")))


def kernel(fn: Callable[..., np.ndarray | None], *args: object) -> Callable[[Column], Column]:
    """A column function that runs ``fn(image, *args)`` on every image. Null and empty images, results of None and kernels that
    fail give null, so one bad image never fails a job."""

    def one(h, w, c, data):
        if data is None or h is None or h * w == 0:
            return None
        try:
            out = fn(to_array(int(h), int(w), int(c), data), *args)
        except Exception:  # errors are data
            return None
        return None if out is None or out.size == 0 else to_row(out)

    @F.pandas_udf(IMAGE)
    def run(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = [one(*x) for x in zip(h.astype(object).where(h.notna(), None), w, c, data)]
        return pd.DataFrame([r or dict.fromkeys("hwc") | {"data": None} for r in rows], columns=["h", "w", "c", "data"]).astype({k: "Int32" for k in "hwc"})

    return lambda image: let(run(image["h"], image["w"], image["c"], image["data"]), lambda out: F.when(out["data"].isNotNull(), out))


def with_model(rows: DataFrame, build: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a model that is built once a task, on its first batch (``build`` returns a function of a batch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if model is None:
                model = build()
            yield model(batch)

    return rows.mapInPandas(run, schema)


def by_shape(rows: DataFrame, width: Column, height: Column, tasks: int) -> DataFrame:
    """Rows spread over ``tasks`` tasks and sorted in each by aspect ratio, so that a model's micro-batches hold like shapes."""
    return rows.repartition(tasks).sortWithinPartitions(width / F.nullif(height, F.lit(0)))


def in_micro_batches(model: Callable[[list[np.ndarray]], list], size: int = 6) -> Callable[[list[np.ndarray]], list]:
    """``model`` over lists of any length: images are sorted by aspect ratio, given in lists of ``size``, and the results put back in
    the order of the images."""

    def run(images: list[np.ndarray]) -> list:
        order = sorted(range(len(images)), key=lambda i: images[i].shape[1] / max(1, images[i].shape[0]))
        out: list = [None] * len(images)
        for lo in range(0, len(order), size):
            part = order[lo : lo + size]
            for i, result in zip(part, model([images[i] for i in part])):
                out[i] = result
        return out

    return run
