"""Session helpers shared by all operators: table access, NTZ-safe time arithmetic and shared-folder checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"^[\s\u00a0\u2000-\u200b\u3000\ufeff]*$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only strings; never null."""
    return col.isNull() | F.coalesce(col.rlike(BLANK), F.lit(True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it (keeps generated code small)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def micros(col: Column) -> Column:
    """Microseconds since 1970 on the wall clock of the value, without any zone conversion (differences stay exact)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``). Where that is unset, a folder of our own, removed at the end, for a
    local master only; on a cluster, whose machines don't share such a folder, an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="tagweave-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialises ``df`` reliably in the shared checkpoint folder, so that later reads survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a columnar table below the shared checkpoint folder, for steps that read some of its columns many times. The
    table goes with the session's checkpoint folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
