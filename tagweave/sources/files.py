"""File sources: dictionaries, stage logs, batch summaries and image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.functions.patterns import path_id
from tagweave.operators.dictionary import load_entries
from tagweave.operators.images import IMAGE, from_files

# The suffixes of image files, in small or in capital letters (not mixed).
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")

DETECTION_LOG = "frameId STRING, numDetections INT, detections ARRAY<STRUCT<className: STRING, confidence: DOUBLE, bbox: ARRAY<INT>, hasMask: BOOLEAN>>, processingTimeMs DOUBLE"
BATCH_SUMMARY = (
    "batch_info STRUCT<input_directory: STRING, timestamp: STRING, total_images: BIGINT, successful: BIGINT, failed: BIGINT, success_rate: DOUBLE>, "
    "timing_summary STRUCT<batch_total_ms: DOUBLE, avg_per_image_ms: DOUBLE, min_image_ms: DOUBLE, max_image_ms: DOUBLE, avg_fps: DOUBLE>, "
    "step_averages_ms MAP<STRING, DOUBLE>, individual_results ARRAY<STRUCT<frameId: STRING, success: BOOLEAN, total_ms: DOUBLE, error: STRING>>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def dictionary(spark: SparkSession, path: str, column: str = "name", upper: bool = True) -> DataFrame:
    """Entries of a JSON dictionary file (an array of objects); none if the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "entry STRING, ord BIGINT")
    # One task reads a multi-line file from top to bottom, so these numbers are the entries' places in the list.
    rows = spark.read.schema(f"`{column}` STRING").option("multiLine", True).json(path).withColumn("__place", F.monotonically_increasing_id() + 1)
    return load_entries(rows, column, upper, "__place")


def detection_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the ``detection_*.json`` files of a folder; unreadable files are skipped, no files give no rows."""
    pattern = f"{folder.rstrip('/')}/detection_*.json"
    if not _exists(spark, pattern):
        return spark.createDataFrame([], DETECTION_LOG)
    return spark.read.schema(DETECTION_LOG).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)


def batch_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the ``batch_summary_*.json`` files with ``batch``, the file's name without suffix."""
    pattern = f"{folder.rstrip('/')}/batch_summary_*.json"
    if not _exists(spark, pattern):
        return spark.createDataFrame([], f"batch STRING, {BATCH_SUMMARY}")
    rows = spark.read.schema(BATCH_SUMMARY).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    return rows.select(F.regexp_replace("_metadata.file_name", r"\.json$", "").alias("batch"), "*")


def batch_results(summaries: DataFrame) -> DataFrame:
    """One row per result of the summaries: ``batch, frame_id, success, total_ms, error``."""
    return summaries.select("batch", F.explode("individual_results").alias("r")).select("batch", F.col("r.frameId").alias("frame_id"), "r.success", "r.total_ms", "r.error")


def image_files(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """``path, frame_id, length, content`` of all image files below a folder, each once, in the order of the path's small letters;
    the first ``limit`` of them if that is above 0. ``frame_id`` is the path below the folder without suffix."""
    pattern = "*.{" + ",".join([*IMAGE_SUFFIXES, *map(str.upper, IMAGE_SUFFIXES)]) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    clean = F.regexp_replace("path", "^file:/+", "/")
    below = F.regexp_replace(clean, f"^.*?{_quoted(folder)}/*", "")
    rows = raw.select(clean.alias("path"), path_id(below).alias("frame_id"), "length", "content").orderBy(F.lower("path"), "path")
    return rows.limit(limit) if limit > 0 else rows


def _quoted(folder: str) -> str:
    return "\\Q" + folder.rstrip("/") + "\\E"


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """``path, image, error`` of the image files that Spark's image source reads; an unreadable one has a null image and the error
    ``Failed to read image``."""
    raw = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    image = from_files(raw)
    return raw.select(F.col("image.origin").alias("path"), image.cast(IMAGE).alias("image"), F.when(image.isNull(), "Failed to read image").cast(T.StringType()).alias("error"))
