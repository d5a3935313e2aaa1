"""Column profiles by load: null shares, distinct counts, ranges, character-class masks, rare masks and drift between loads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.runtime import BLANK


@dataclass(frozen=True)
class Form:
    """The usual form of a column, told on its *mask* (``A`` capital, ``a`` small letter, ``9`` digit, others as they are), and
    for date columns the date pattern that the value must also meet."""

    mask: str
    date_format: str | None = None


# Classes beyond ASCII and the sign that stands for each; then the ASCII classes.
_CLASSES = ((r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}&&[^\x00-\x7F]]", "\u00fc"), (r"[\p{Lu}&&[^\x00-\x7F]]", "\u00dc"), ("[A-Z]", "A"), ("[a-z]", "a"), ("[0-9]", "9"))


def mask(value: Column) -> Column:
    """The value with every ASCII capital as ``A``, small letter as ``a`` and digit as ``9``, and letters beyond ASCII as ``\u00dc`` (capitals)
    and ``\u00fc`` (others); one character each, others kept."""
    for form, sign in _CLASSES:
        value = F.regexp_replace(value, form, sign)
    return value


def short_mask(value: Column) -> Column:
    """The mask with runs of one class written once (``A9-9+``): the generalisation used for dominant patterns and drift."""
    return F.regexp_replace(mask(value), "([Aa9\u00dc\u00fc])\\1+", "$1+")


def code_date(value: Column) -> Column:
    """The real date of a six-digit ``MMDDYY`` text (years 20YY), else null."""
    iso = F.concat(F.lit("20"), F.substring(value, 5, 2), F.lit("-"), F.substring(value, 1, 2), F.lit("-"), F.substring(value, 3, 2))
    return F.when(value.rlike("^[0-9]{6}$"), iso.try_cast("date"))


def value_counts(rows: DataFrame, load: Column, columns: dict[str, Column], dated: dict[str, Column] | None = None, at: Column | None = None, far_months: int = 24) -> DataFrame:
    """``load, column_name, value, n, n_far``: the one pass over the rows; all findings come from these counts.

    Null, empty and blank values are counted together as null. ``n_far`` counts the rows whose date (``dated``: column name to
    date expression) lies more than ``far_months`` from the day of ``at``. Combined map-side, so a load or value with a third
    of all rows reaches no single task as rows.
    """
    dated, day = dated or {}, F.to_date(at) if at is not None else F.lit(None).cast("date")
    far = lambda d: ((day < F.add_months(d, -far_months)) | (day > F.add_months(d, far_months))).cast("int")
    cells = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.when(~col.rlike(BLANK), col).alias("value"),
            F.coalesce(far(dated[name]) if name in dated else F.lit(0), F.lit(0)).alias("is_far"),
        )
        for name, col in ((k, v.cast("string")) for k, v in columns.items())
    ]
    long = rows.select(load.alias("load"), F.explode(F.array(*cells)).alias("c"))
    return long.groupBy("load", F.col("c.column_name").alias("column_name"), F.col("c.value").alias("value")).agg(
        F.count("*").alias("n"), F.sum("c.is_far").alias("n_far")
    )


def masked(counts: DataFrame, forms: dict[str, Form]) -> DataFrame:
    """``counts`` with ``mask``: the value's mask, empty for no value, and ``!`` behind the mask of a text in a date column that is no real date."""
    name, value = F.col("column_name"), F.col("value")
    unreal = F.lit(False)
    for column, form in forms.items():
        if form.date_format:
            real = code_date(value) if form.date_format == "MMddyy" else F.try_to_date(value, form.date_format)
            unreal = F.when(name == column, real.isNull()).otherwise(unreal)
    return counts.withColumn("mask", F.when(value.isNull(), "").otherwise(F.concat(mask(value), F.when(unreal, "!").otherwise(""))))


def mined(masks: DataFrame, forms: dict[str, Form], rare: float = 0.005) -> DataFrame:
    """``column_name, mask, share, is_rare, is_usual``: the patterns of each column over all loads, mined from ``masks`` (``column_name, mask, n``).
    A mask under ``rare`` of the values is rare; one that meets the column's form is usual, and where a column has no form, one that isn't rare."""
    all_n = masks.where("mask <> ''").groupBy("column_name", "mask").agg(F.sum("n").alias("n"))
    total = all_n.groupBy("column_name").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    usual = share >= rare
    for column, form in forms.items():
        usual = F.when(F.col("column_name") == column, F.col("mask").rlike(form.mask)).otherwise(usual)
    return all_n.join(F.broadcast(total), "column_name").select("column_name", "mask", share.alias("share"), (share < rare).alias("is_rare"), usual.alias("is_usual"))


def profile(counts: DataFrame, forms: dict[str, Form], rare: float = 0.005) -> DataFrame:
    """One row per load and column: rows, empty share, distinct values, least and greatest value, lengths, malformed, rare and far
    shares, the dominant mask with its share, the divergence of the load's masks from all loads', and the most over-represented
    value with its lift over all loads.

    Values are generalised to masks and the masks' patterns mined over all loads (``mined``); a load's masks are then held against
    these patterns: what falls outside the usual ones is malformed, the empty mask tells the values that are missing. ``divergence`` is
    Jensen-Shannon's, in bits, of the load's mask mix from that of all loads; ``top_lift`` the greatest surplus of a value's
    share, the same comparison at the finest mask, the value itself. Shares but the empty one are of the rows with a value, and null
    where there is none. An empty table has no loads, so no rows.
    """
    by_mask = masked(counts, forms).groupBy("load", "column_name", "mask").agg(
        F.sum("n").alias("n"), F.sum("n_far").alias("far"), F.count("value").alias("n_values"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(F.length("value")).alias("short"), F.max(F.length("value")).alias("long")
    )
    patterns = mined(by_mask, forms, rare)
    there = F.col("mask") != ""
    held = by_mask.join(patterns, ["column_name", "mask"], "left")
    held = held.withColumn("present", F.sum(F.when(there, F.col("n")).otherwise(0)).over(W.partitionBy("load", "column_name")))
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    p, q = F.col("n") / F.col("present"), F.col("share")
    mid = (p + q) / 2
    term = F.when(there, 0.5 * p * F.log2(p / mid) + 0.5 * q * F.log2(q / mid) - 0.5 * q)
    per = held.groupBy("load", "column_name").agg(
        F.sum("n").alias("n_rows"),
        of(there).alias("n_present"),
        F.sum("n_values").alias("n_distinct"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
        F.min("short").alias("min_length"),
        F.max("long").alias("max_length"),
        of(there & ~F.col("is_usual")).alias("n_malformed"),
        of(there & F.col("is_rare")).alias("n_rare"),
        F.sum("far").alias("n_far"),
        F.greatest(F.lit(0.0), F.lit(0.5) + F.sum(term)).alias("divergence"),
    )
    present = F.col("value").isNotNull()
    overall = counts.where(present).groupBy("column_name", "value").agg(F.sum("n").alias("all_n"))
    totals = overall.groupBy("column_name").agg(F.sum("all_n").alias("all_rows"))
    share = counts.where(present).join(overall, ["column_name", "value"]).join(F.broadcast(totals), "column_name")
    share = share.join(per.select("load", "column_name", "n_present"), (share["load"].eqNullSafe(per["load"])) & (share["column_name"] == per["column_name"])).select(
        share["load"], share["column_name"], "value", (F.col("n") / F.col("n_present") - F.col("all_n") / F.col("all_rows")).alias("lift")
    )
    top = share.groupBy("load", "column_name").agg(F.max("lift").alias("top_lift"), F.max_by("value", F.struct("lift", "value")).alias("top_value"))
    masks = counts.where(present).groupBy("load", "column_name", short_mask(F.col("value")).alias("m")).agg(F.sum("n").alias("n"))
    common = masks.groupBy("load", "column_name").agg(F.max_by("m", F.struct("n", "m")).alias("dominant_mask"), F.max("n").alias("dominant_n"))
    out = per.alias("p")
    for extra in (top, common):
        e = extra.withColumnsRenamed({"load": "load_2", "column_name": "column_2"})
        out = out.join(e, F.col("p.load").eqNullSafe(F.col("load_2")) & (F.col("p.column_name") == F.col("column_2")), "left").drop("load_2", "column_2")
    part = lambda n: F.try_divide(F.col(n), F.col("n_present"))
    return out.withColumns(
        {"null_share": (F.col("n_rows") - F.col("n_present")) / F.col("n_rows"), "malformed_share": part("n_malformed"), "rare_share": part("n_rare"), "far_share": part("n_far"), "dominant_share": part("dominant_n")}
    )


def findings(profiles: DataFrame, share: float = 0.15, lift: float = 0.40, with_mix: tuple[str, ...] = (), with_range: tuple[str, ...] = ()) -> DataFrame:
    """``load, column_name, finding``: the loads in which a column is out of the ordinary (``nulls``, ``pattern``, ``range``, ``mix``)."""
    eps = 1e-12
    name = F.col("column_name")
    kinds = F.array(
        F.when(F.col("null_share") >= share - eps, F.lit("nulls")),
        F.when(F.col("malformed_share") >= share - eps, F.lit("pattern")),
        F.when(name.isin(*with_range) & (F.col("far_share") >= share - eps), F.lit("range")),
        F.when(name.isin(*with_mix) & (F.col("top_lift") >= lift - eps), F.lit("mix")),
    )
    return profiles.select("load", "column_name", F.explode(F.array_compact(kinds)).alias("finding"))


def rare_masks(counts: DataFrame, rare: float = 0.005) -> DataFrame:
    """``column_name, mask, n, share, n_values, example, is_rare``: the masks of each column over all loads; those under
    ``rare`` of the rows with a value are violations of the mined patterns."""
    m = counts.where("value is not null").groupBy("column_name", short_mask(F.col("value")).alias("mask")).agg(
        F.sum("n").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("example")
    )
    total = m.groupBy("column_name").agg(F.sum("n").alias("total"))
    return m.join(F.broadcast(total), "column_name").select(
        "column_name", "mask", "n", (F.col("n") / F.col("total")).alias("share"), "n_values", "example", (F.col("n") / F.col("total") < rare).alias("is_rare")
    )


def mask_drift(counts: DataFrame) -> DataFrame:
    """``load, column_name, divergence``: Jensen-Shannon divergence (bits, 0 to 1) of the mask mix of a load against all loads.

    Computed as sums over masks, a mask missing in the load adding the half that it has in all loads; no pair of loads is formed.
    """
    m = counts.where("value is not null and load is not null").groupBy("load", "column_name", short_mask(F.col("value")).alias("mask")).agg(F.sum("n").alias("n"))
    everywhere = m.groupBy("column_name", "mask").agg(F.sum("n").alias("a"))
    load_n = m.groupBy("load", "column_name").agg(F.sum("n").alias("ln"))
    all_n = everywhere.groupBy("column_name").agg(F.sum("a").alias("an"))
    j = m.join(everywhere, ["column_name", "mask"]).join(load_n, ["load", "column_name"]).join(F.broadcast(all_n), "column_name")
    p, q = F.col("n") / F.col("ln"), F.col("a") / F.col("an")
    mid = (p + q) / 2
    term = 0.5 * p * F.log2(p / mid) + 0.5 * q * F.log2(q / mid) - 0.5 * q
    return j.groupBy("load", "column_name").agg(F.round(F.greatest(F.lit(0.0), F.lit(0.5) + F.sum(term)), 6).alias("divergence"))


def drift_between(counts: DataFrame) -> DataFrame:
    """``load, previous_load, column_name, divergence``: Jensen-Shannon divergence of a load's mask mix from that of the load before."""
    m = counts.where("value is not null and load is not null").groupBy("load", "column_name", short_mask(F.col("value")).alias("mask")).agg(F.sum("n").alias("n"))
    loads = m.groupBy("column_name", "load").agg(F.sum("n").alias("ln"))
    loads = loads.withColumn("previous_load", F.lag("load").over(W.partitionBy("column_name").orderBy("load")))
    share = m.join(loads, ["column_name", "load"]).select("column_name", "load", "previous_load", "mask", (F.col("n") / F.col("ln")).alias("p"))
    following = loads.where("previous_load is not null").select("column_name", F.col("load").alias("next_load"), F.col("previous_load").alias("load"))
    before = share.drop("previous_load").join(following, ["column_name", "load"]).select("column_name", F.col("next_load").alias("load"), "mask", F.lit(0.0).alias("p"), F.col("p").alias("q"))
    now = share.where("previous_load is not null").select("column_name", "load", "mask", "p", F.lit(0.0).alias("q"))
    pq = now.unionByName(before).groupBy("column_name", "load", "mask").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(F.col(x) > 0, 0.5 * F.col(x) * F.log2(F.col(x) / mid)).otherwise(0.0)
    js = pq.groupBy("column_name", "load").agg(F.round(F.sum(half("p") + half("q")), 6).alias("divergence"))
    return js.join(loads.select("column_name", "load", "previous_load"), ["column_name", "load"]).select("load", "previous_load", "column_name", "divergence")
