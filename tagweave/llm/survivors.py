"""The best representative of each group of duplicate records, whole or field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagweave.runtime import is_blank


@dataclass(frozen=True)
class FieldRule:
    """How one field's survivor is chosen: among the records whose ``value`` isn't blank, the first in the order of ``ranks``
    (each: greatest first, null last)."""

    value: Column
    ranks: tuple[Column, ...]


def _top(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """The first row of each group ``__g``; Spark plans a group limit before the shuffle, so a group with a third of all rows
    sends at most one row per task."""
    order = [F.desc_nulls_last(r) for r in ranks] + [F.desc("__id")]
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy("__g").orderBy(*order))).where("__rn = 1")


def field_survivors(records: DataFrame, group: Column, record_id: Column, rules: dict[str, FieldRule], least_records: int = 2, salts: int = 32) -> DataFrame:
    """One row per group with at least ``least_records`` (1 or 2) different record ids: ``group_key``, and per rule
    ``<field>_record_id`` and ``<field>_value`` of the record from which the field survives (null if all are blank).

    Method: per field, a window ordering by the rule's ranks with the greatest record id as the last word, keeping the top row.
    All fields are ranked over one scan and one shuffle. Ranking is done twice: within ``salts`` parts of each group, keeping the
    top row of each field, then over what is left of the group, so a group with a third of all rows is no single task.

    Defined results: records with a null group or id are left out; exact repeats of a record count once; blank means null, empty
    or white space only; no records give no rows; other columns of ``records`` play no part.
    """
    if least_records not in (1, 2):
        raise ValueError("least_records must be 1 or 2")
    ranks = {str(r): r for rule in rules.values() for r in rule.ranks}
    names = {text: f"__r{i}" for i, text in enumerate(ranks)}
    rows = records.select(
        group.alias("__g"),
        record_id.alias("__id"),
        *[F.when(~is_blank(rule.value), rule.value).alias(f"__v_{n}") for n, rule in rules.items()],
        *[r.alias(names[text]) for text, r in ranks.items()],
    ).where("__g is not null and __id is not null")
    rows = rows.withColumns({"__lo": F.col("__id"), "__hi": F.col("__id"), "__s": F.pmod(F.xxhash64("__id"), F.lit(salts))})

    def topped(rows: DataFrame, *parts: str) -> DataFrame:
        """The rows that are first for some field in their part, with the part's least and greatest id."""
        order = {n: [F.col(f"__v_{n}").isNull(), *[F.desc_nulls_last(names[str(r)]) for r in rule.ranks], F.desc("__id")] for n, rule in rules.items()}
        at = {f"__n_{n}": F.row_number().over(W.partitionBy(*parts).orderBy(*o)) for n, o in order.items()}
        whole = W.partitionBy(*parts)
        ranked = rows.withColumns({**at, "__lo": F.min("__lo").over(whole), "__hi": F.max("__hi").over(whole)})
        first = F.lit(False)
        for n in at:
            first = first | (F.col(n) == 1)
        return ranked.where(first) if rules else ranked

    left = topped(topped(rows, "__g", "__s"), "__g")
    picked = [F.max(F.when((F.col(f"__n_{n}") == 1) & F.col(f"__v_{n}").isNotNull(), F.struct(F.col("__id"), F.col(f"__v_{n}").alias("v")))).alias(f"__p_{n}") for n in rules]
    out = left.groupBy("__g").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), *picked)
    out = out if least_records == 1 else out.where("__lo < __hi")
    return out.select(F.col("__g").alias("group_key"), *[c for n in rules for c in (F.col(f"__p_{n}.__id").alias(f"{n}_record_id"), F.col(f"__p_{n}.v").alias(f"{n}_value"))])


def best_records(records: DataFrame, group: Column, record_id: Column, fields: list[Column], ranks: tuple[Column, ...], keep: dict[str, Column]) -> DataFrame:
    """One whole surviving record per group: ``group_key, record_id, n_filled, *keep``.

    The most complete record (most of ``fields`` not blank), then the order of ``ranks`` (greatest first, null last), then the
    greatest record id. Null groups and ids are left out; exact repeats make no difference.
    """
    filled = sum(((~is_blank(f)).cast("int") for f in fields), F.lit(0))
    names = [f"__r{i}" for i in range(len(ranks))]
    rows = records.where(group.isNotNull() & record_id.isNotNull()).select(
        group.alias("__g"), record_id.alias("__id"), filled.alias("__filled"), *[r.alias(n) for r, n in zip(ranks, names)], *[c.alias(k) for k, c in keep.items()]
    )
    return _top(rows, ["__filled", *names]).select(F.col("__g").alias("group_key"), F.col("__id").alias("record_id"), F.col("__filled").alias("n_filled"), *keep)
