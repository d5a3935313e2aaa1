"""Stages composed into a plan: gates, short circuit, error labels and the messages of a preprocessing chain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.runtime import written

# The error labels of a result, by the stage that failed.
STAGE_ERRORS = {
    "s2": "No label detected",
    "s3_off": "Preprocessing disabled",
    "s3": "Preprocessing failed",
    "s5": "No QR code detected",
    "s6": "Component extraction failed",
    "s8": "Postprocessing failed",
}
_REACHED = {"No label detected": 2, "Preprocessing disabled": 3, "Preprocessing failed": 3, "No QR code detected": 5, "Component extraction failed": 6, "Postprocessing failed": 8}


def reached_stage(error: Column) -> Column:
    """Number of the last stage that a result reached; 8 without error. Frames that end before stage 5 log no timing."""
    out = F.lit(8)
    for label, stage in _REACHED.items():
        out = F.when(error == label, stage).otherwise(out)
    return out


@dataclass(frozen=True)
class Stage:
    """One step of a plan. ``run`` adds the step's columns; ``ok`` tells from them whether a row passed. ``when_off`` says what a
    disabled step does: ``empty`` and ``pass`` let every row through (the first without the step's columns set), ``fail`` ends
    every row with ``error_off``."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    ok: Column
    error: str
    enabled: bool = True
    when_off: str = "fail"
    error_off: str | None = None


@dataclass(frozen=True)
class Pipeline:
    """Stages in order over rows keyed by ``key``; rows that failed a stage aren't given to the next ones. ``keep`` holds a stage's result,
    which both the next stage and the output read, so that no stage (and no model in it) runs twice; by default it is written to
    the shared checkpoint folder."""

    key: str
    stages: tuple[Stage, ...] = field(default=())
    keep: Callable[[DataFrame], DataFrame] = written

    def apply(self, frames: DataFrame) -> DataFrame:
        """``frames`` with the stages' columns, ``success``, ``error`` and ``stage``: the label and name of the first failed
        stage. Failed rows are kept, with null in the columns of later stages; a null ``ok`` fails."""
        alive, ended = frames, []
        for s in self.stages:
            if not s.enabled:
                if s.when_off == "fail":
                    ended.append(alive.select("*", F.lit(s.error_off or s.error).alias("error"), F.lit(s.name).alias("stage")))
                    alive = alive.where(F.lit(False))
                continue
            done = self.keep(s.run(alive))
            ok = F.coalesce(s.ok, F.lit(False))
            ended.append(done.where(~ok).select("*", F.lit(s.error).alias("error"), F.lit(s.name).alias("stage")))
            alive = done.where(ok)
        out = alive.select("*", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("stage"))
        for part in ended:
            out = out.unionByName(part, allowMissingColumns=True)
        return out.withColumn("success", F.col("error").isNull())


def guard(image: Column, points: Column, least: int = 3) -> Column:
    """Whether a row has an image and at least ``least`` points."""
    return F.coalesce(image.isNotNull() & (F.size(points) >= least), F.lit(False))
