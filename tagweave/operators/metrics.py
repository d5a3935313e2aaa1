"""Stage timings, batch summaries, backend comparison, error triage and rolling rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.functions.patterns import frames_a_second


def success_rate(success: Column, total: Column) -> Column:
    """Percentage to two places, 0 of nothing."""
    return F.when(total > 0, F.round(100.0 * success / total, 2)).otherwise(0.0)


def batch_summary(results: DataFrame, batch: list[Column], success: Column, timing: Column) -> DataFrame:
    """Per batch: ``total, successful, failed, success_rate, avg_ms, min_ms, max_ms, avg_fps``. ``timing`` is a MAP of stage to
    milliseconds; results without one (unreadable images) count, but not in the averages; a map without ``total`` counts 0."""
    timed = F.when(timing.isNotNull(), F.coalesce(timing["total"], F.lit(0.0)))
    rows = results.select(*batch, F.coalesce(success, F.lit(False)).alias("__ok"), timed.alias("__ms"))
    keys = rows.columns[: len(batch)]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("__ok").alias("successful"), F.coalesce(F.avg("__ms"), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.min("__ms"), F.lit(0.0)).alias("min_ms"), F.coalesce(F.max("__ms"), F.lit(0.0)).alias("max_ms")
    )
    return out.select(
        *keys, "total", "successful", (F.col("total") - F.col("successful")).alias("failed"), success_rate(F.col("successful"), F.col("total")).alias("success_rate"), "avg_ms", "min_ms", "max_ms", frames_a_second(F.col("avg_ms")).alias("avg_fps")
    )


def stage_averages(results: DataFrame, timing: Column) -> DataFrame:
    """``stage, n, avg_ms`` over the results whose timing names the stage."""
    return results.select(F.explode(timing).alias("stage", "ms")).where("ms is not null").groupBy("stage").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"))


def _middle(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    """``*by, median``: the exact median (the mean of the two middle values of an even number).

    An approximate percentile of bounded size gives two values that enclose the middle ranks; only the few rows between them are
    counted by value and put in order, so no buffer or task holds a group.
    """
    near = rows.groupBy(*by).agg(F.count(ms).alias("__n"), F.count_if(F.col(ms).isNotNull()).alias("__all"), F.percentile_approx(ms, F.array(F.lit(0.499), F.lit(0.501)), F.lit(10_000)).alias("__r"))
    near = near.where("__n > 0").withColumnsRenamed({c: f"__{c}_2" for c in by}).drop("__all")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}_2"))
    held = rows.where(F.col(ms).isNotNull()).join(near, on)
    low, high = F.col("__r")[0], F.col("__r")[1]
    place = F.when(F.col(ms) < low, F.lit(None)).otherwise(F.col(ms))
    counts = held.where(F.col(ms) <= high).groupBy(*by, place.alias("__v")).agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    upto = F.sum("__c").over(W.partitionBy(*by).orderBy(F.asc_nulls_first("__v")))
    ranked = counts.withColumn("__z", upto).withColumn("__a", F.col("__z") - F.col("__c"))
    first, last = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    value = lambda k: F.max(F.when((F.col("__a") <= k) & (k < F.col("__z")), F.col("__v")))
    return ranked.groupBy(*by).agg(((value(first) + value(last)) / 2).alias("median"))


def latency_stats(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    """``n, mean_ms, median_ms, min_ms, max_ms, std_ms`` (median interpolated, deviation of the population) per group; nulls ignored."""
    c = F.col(ms)
    out = rows.groupBy(*by).agg(
        F.count(c).alias("n"),
        F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_ms"),
        F.coalesce(F.min(c), F.lit(0.0)).alias("min_ms"),
        F.coalesce(F.max(c), F.lit(0.0)).alias("max_ms"),
        F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("std_ms"),
    )
    middle = _middle(rows.select(*by, c), by, ms).withColumnsRenamed({k: f"__{k}_3" for k in by})
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}_3"))
    return out.join(middle, on, "left").select(*by, "n", "mean_ms", F.coalesce("median", F.lit(0.0)).alias("median_ms"), "min_ms", "max_ms", "std_ms")


def compare_backends(stats: DataFrame, backend: str, base: str, other: str) -> DataFrame:
    """One row: both backends' means side by side, their difference, the gain of ``other`` over ``base`` in percent of ``base``, and
    which is faster (``base`` on a tie); no row if a backend has no statistics."""
    of = lambda name, c: F.max(F.when(F.col(backend) == name, F.col(c)))
    both = stats.agg(of(base, "mean_ms").alias("base_ms"), of(other, "mean_ms").alias("other_ms"), of(base, "n").alias("base_ms_n"), of(other, "n").alias("other_ms_n"))
    both = both.where("base_ms is not null and other_ms is not null")
    gain = F.when(F.col("base_ms") > 0, (F.col("base_ms") - F.col("other_ms")) / F.col("base_ms") * 100).otherwise(0.0)
    return both.select(
        F.lit(base).alias("base"), F.lit(other).alias("other"), "base_ms", "other_ms", "base_ms_n", "other_ms_n", F.abs(F.col("base_ms") - F.col("other_ms")).alias("difference_ms"), gain.alias("gain_percent"),
        F.when(gain > 0, F.lit(other)).otherwise(F.lit(base)).alias("faster"), frames_a_second(F.col("base_ms")).alias("base_fps"), frames_a_second(F.col("other_ms")).alias("other_fps"),
    )


def error_frames(results: DataFrame, batch: str, frame: str, error: Column, wanted: str) -> DataFrame:
    """``batch, frame``: the frames of each batch that have the wanted error, once each; rows, not an array, so a batch may have any number."""
    return results.where(F.coalesce(error == wanted, F.lit(False))).select(batch, frame).distinct()


def error_triage(results: DataFrame, batch: str, error: Column, wanted: str) -> DataFrame:
    """``batch, total, errors, error_rate`` per batch, and the grand total in a row with a null batch (``is_total``)."""
    rows = results.select(F.col(batch), F.coalesce(error == wanted, F.lit(False)).alias("__bad"))
    by = rows.rollup(batch).agg(F.count("*").alias("total"), F.count_if("__bad").alias("errors"), F.grouping(batch).cast("boolean").alias("is_total"))
    return by.select(batch, "is_total", "total", "errors", success_rate(F.col("errors"), F.col("total")).alias("error_rate"))


def error_files(results: DataFrame, frame: str, error: Column, wanted: str, files: DataFrame, file_frame: str) -> tuple[DataFrame, DataFrame]:
    """Frames with the wanted error that have a file (to copy) and that have none (to warn about)."""
    bad = results.where(F.coalesce(error == wanted, F.lit(False))).select(frame).distinct()
    there = files.select(F.col(file_frame).alias("__file")).distinct()
    on = bad[frame] == there["__file"]
    return bad.join(there, on, "left_semi"), bad.join(there, on, "left_anti")


def first_failing_stage(checks: list[tuple[Column, str]]) -> Column:
    """The label of the first stage whose check isn't true, null if all are: the error of a result."""
    out = F.lit(None).cast("string")
    for ok, label in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def metric_verdict(relative: Column) -> Column:
    """Verdict on a relative loss of accuracy: within 2 percent, within 5, or more."""
    loss = F.abs(relative)
    return F.when(loss < 0.02, "negligible").when(loss < 0.05, "acceptable").otherwise("significant")


def generalization_verdict(box_gap: Column, mask_gap: Column) -> Column:
    """Validation against test: both gaps under 0.05 in size generalise well, either below -0.1 is overfitted, else moderate."""
    return F.when((F.abs(box_gap) < 0.05) & (F.abs(mask_gap) < 0.05), "good").when((box_gap < -0.1) | (mask_gap < -0.1), "overfit").otherwise("moderate")


def numbered(rows: DataFrame, entity: str, bucket: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``n``, the row number (from 1) within the entity in ``order``, ``bucket`` being a coarse part of that order.

    Numbers are taken inside (entity, bucket) and shifted by the buckets before, so an entity with a third of all rows is no
    single task.
    """
    b = rows.withColumn("__b", bucket)
    before = b.groupBy(entity, "__b").agg(F.count("*").alias("__c"))
    before = before.select(F.col(entity).alias("__e"), F.col("__b").alias("__b2"), (F.sum("__c").over(W.partitionBy(entity).orderBy("__b")) - F.col("__c")).alias("__o"))
    local = b.withColumn("__r", F.row_number().over(W.partitionBy(entity, "__b").orderBy(*order)))
    joined = local.join(before, F.col(entity).eqNullSafe(F.col("__e")) & F.col("__b").eqNullSafe(F.col("__b2")))
    return joined.withColumn("n", F.col("__r") + F.col("__o")).drop("__b", "__b2", "__e", "__c", "__o", "__r")


def rolling_mean(rows: DataFrame, entity: str, bucket: Column, order: list[str], value: str, last: int = 200, block: int = 4096) -> DataFrame:
    """``rows`` with ``n``, ``rolling_mean`` of ``value`` over the ``last`` rows up to each, and ``rolling_fps``.

    Rows are numbered per entity and cut into blocks; the last rows of a block are repeated in front of the next, so each block's
    window is whole by itself and no task holds an entity.
    """
    step = max(block, last)
    n = numbered(rows, entity, bucket, order).withColumn("__k", F.floor((F.col("n") - 1) / step))
    lead = F.when((F.col("n") - 1) % step >= step - (last - 1), F.array(F.col("__k"), F.col("__k") + 1)).otherwise(F.array(F.col("__k")))
    spread = n.withColumn("__in", F.explode(lead))
    w = W.partitionBy(entity, "__in").orderBy("n").rowsBetween(-(last - 1), 0)
    out = spread.withColumn("rolling_mean", F.avg(value).over(w)).where(F.col("__in") == F.col("__k")).drop("__in", "__k")
    return out.withColumn("rolling_fps", frames_a_second(F.col("rolling_mean")))
