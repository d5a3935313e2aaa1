"""Runs of repeated consecutive events, collapsed to one event each (row-number difference, in two levels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.runtime import micros


def collapse_runs(
    events: DataFrame,
    entity: Column,
    event_id: Column,
    ts: Column,
    value: Column,
    complete: Column | None = None,
    max_gap_s: float = 60.0,
    bucket_s: int = 3600,
    shape_only: bool = False,
) -> DataFrame:
    """One row per maximal run of one value under one entity: ``entity, value, first_id, last_id, first_ts, last_ts, n_events, duration_s``.

    Method: within-entity row number minus within-entity-and-value row number is constant exactly along a run. So that an
    entity with a third of all rows is no single task, the rows of an entity are cut into time buckets of ``bucket_s``
    seconds; the difference is taken inside each bucket, and only the first and last piece of a bucket (two rows, whatever
    the bucket holds) are joined across buckets, by the same difference over pieces. More than ``max_gap_s`` seconds between
    two events of an entity always part them.

    ``complete`` false marks a reading that lost its end: it takes the value around it if the nearest complete readings
    before and after agree and begin with it, else it stands for itself. With ``shape_only``, ``complete`` only tells that a
    reading has the shape of a whole value, which one that lost just an optional end has too: a reading taken for complete whose
    nearest complete readings before and after agree, are longer and begin with it, takes their value first, if no gap of more
    than ``max_gap_s`` lies between the two. Two such readings running stay a value of their own.

    Defined results: rows with a null entity, id, time or value are left out and interrupt nothing; an id delivered several
    times under an entity counts once (earliest time, a complete reading before a cut one); equal times are ordered by id;
    no events give no rows. Other columns of ``events`` play no part, whatever their names.
    """
    whole = F.lit(True) if complete is None else F.coalesce(complete, F.lit(False))
    base = events.select(
        entity.alias("e"), event_id.alias("i"), micros(ts).alias("us"), value.alias("v"), whole.alias("c")
    ).where("e is not null and i is not null and us is not null and v is not null")
    once = base.groupBy("e", "i").agg(F.min(F.struct("us", (~F.col("c")).alias("cut"), "v")).alias("m"))
    step = int(bucket_s) * 1_000_000
    once = once.select("e", "i", "m.us", "m.v", (~F.col("m.cut")).alias("c"), F.floor(F.col("m.us") / step).alias("b"))

    local, back = W.partitionBy("e", "b").orderBy("us", "i"), W.partitionBy("e", "b").orderBy(F.desc("us"), F.desc("i"))
    before = W.unboundedPreceding, -1
    gap = int(max_gap_s * 1_000_000)
    once = once.withColumn("x", F.when(F.col("us") - F.lag("us").over(local) > gap, 1).otherwise(0)).withColumn("g", F.sum("x").over(local))
    if complete is not None:
        # Nearest complete readings: value, part of the entity between gaps, and the complete reading beyond (q).
        last = lambda c, w: F.last(c, True).over(w.rowsBetween(*before))
        known = lambda *q: F.when(F.col("c"), F.struct("v", "g", *q))
        once = once.select("*", last(known(), local).alias("p"), last(known(), back).alias("n"))
        left, right = F.struct("v", "g", F.col("p").alias("q")), F.struct("v", "g", F.col("n").alias("q"))
        at = F.when(F.col("c"), F.struct("us", "i"))
        edges = once.groupBy("e", "b").agg(
            F.min("us").alias("a"), F.max("us").alias("z"), F.max("g").alias("parts"), F.min_by(right, at).alias("first_c"), F.max_by(left, at).alias("last_c")
        )
        once = once.select("*", last(known(F.col("p").alias("q")), local).alias("l"), last(known(F.col("n").alias("q")), back).alias("r"))

        # Parts are numbered in each bucket; ``base`` makes the numbers those of the entity.
        fore, aft = W.partitionBy("e").orderBy("b"), W.partitionBy("e").orderBy(F.desc("b"))
        edges = edges.withColumn("x", F.when(F.col("a") - F.lag("z").over(fore) > gap, 1).otherwise(0))
        edges = edges.withColumn("base", F.sum("x").over(fore.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("parts").over(fore.rowsBetween(*before)), F.lit(0)))
        two = lambda m: F.when(m.isNotNull(), F.struct(m["v"].alias("v"), m["g"].alias("g")))
        based = lambda m: F.when(m.isNotNull(), F.struct(m["v"].alias("v"), (m["g"] + F.col("base")).alias("g")))
        filled = lambda m, beyond: F.when(m.isNotNull(), F.struct(m["v"].alias("v"), (m["g"] + F.col("base")).alias("g"), F.coalesce(based(m["q"]), two(beyond)).alias("q")))
        first_c, last_c = F.col("first_c"), F.col("last_c")
        edges = edges.select("e", "b", "base", "first_c", "last_c", last(based(last_c), fore).alias("p"), last(based(first_c), aft).alias("n"))
        edges = edges.select("e", "b", "base", filled(last_c, F.col("p")).alias("last_c"), filled(first_c, F.col("n")).alias("first_c"))
        edges = edges.select("e", "b", "base", last(last_c, fore).alias("from_before"), last(first_c, aft).alias("from_after"))
        once = once.drop("p", "n").join(edges, ["e", "b"])

        p = F.coalesce(filled(F.col("l"), F.col("from_before")), F.col("from_before"))
        n = F.coalesce(filled(F.col("r"), F.col("from_after")), F.col("from_after"))
        once = once.select("e", "b", "us", "i", "v", "c", "g", p.alias("p"), n.alias("n"))
        p, n, v = F.col("p"), F.col("n"), F.col("v")
        lost = lambda x, one, other: (one["v"] == other["v"]) & (one["g"] == other["g"]) & (x != one["v"]) & F.startswith(one["v"], x)
        around = F.when(p["v"] == n["v"], p["v"])
        if shape_only:
            around = around.when(lost(p["v"], p["q"], n), n["v"]).when(lost(n["v"], p, n["q"]), p["v"])
        own = F.when(lost(v, p, n), p["v"]).otherwise(v) if shape_only else v
        once = once.select("e", "b", "us", "i", "g", F.when(F.col("c"), own).when(F.startswith(around, v), around).otherwise(v).alias("v"))

    rows = once.select("e", "b", "us", "i", "v", "g", F.row_number().over(local).alias("re"), F.lead("us").over(local).isNull().alias("z"))
    rows = rows.withColumn("d", F.col("re") - F.row_number().over(W.partitionBy("e", "b", "v", "g").orderBy("us", "i")))
    pieces = rows.groupBy("e", "b", "v", "g", "d").agg(
        F.min(F.struct("us", "i")).alias("a"),
        F.max(F.struct("us", "i")).alias("z"),
        F.count("*").alias("n"),
        (F.min("re") == 1).alias("is_first"),
        F.max("z").alias("is_last"),
    )
    inner = pieces.where(~F.col("is_first") & ~F.col("is_last")).select("e", "v", "a", "z", "n")

    along = W.partitionBy("e").orderBy("a")
    outer = pieces.where(F.col("is_first") | F.col("is_last"))
    apart = (F.col("a.us") - F.lag("z.us").over(along) > gap) | (F.col("b") == F.lag("b").over(along))
    outer = outer.select("*", F.when(apart, 1).otherwise(0).alias("x"), F.row_number().over(along).alias("re"))
    outer = outer.withColumn("h", F.sum("x").over(along))
    outer = outer.withColumn("k", F.col("re") - F.row_number().over(W.partitionBy("e", "v", "h").orderBy("a")))
    joined = outer.groupBy("e", "v", "h", "k").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n")).drop("h", "k")

    moment = lambda c: F.timestamp_add("MICROSECOND", c, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return inner.unionByName(joined).select(
        F.col("e").alias("entity"),
        F.col("v").alias("value"),
        F.col("a.i").alias("first_id"),
        F.col("z.i").alias("last_id"),
        moment(F.col("a.us")).alias("first_ts"),
        moment(F.col("z.us")).alias("last_ts"),
        F.col("n").alias("n_events"),
        ((F.col("z.us") - F.col("a.us")) / 1e6).alias("duration_s"),
    )
