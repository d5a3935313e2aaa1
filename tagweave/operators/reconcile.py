"""Differences between two copies of a table, found with invertible Bloom lookup tables (IBLT) per key bucket."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.runtime import cut_lineage

_HASHES = 3
# The five primes of the public XXH64 function, as Spark's xxhash64 uses them.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


@dataclass(frozen=True)
class Field:
    """A compared field: its value, a digest that is equal for all values the comparison calls equal *or merely close*
    (unequal digests only make a candidate, never a finding), and the test on two values, nulls excluded."""

    value: Column
    digest: Callable[[Column], Column] = field(default=lambda c: c)
    differs: Callable[[Column, Column], Column] = field(default=lambda a, b: a != b)


def close_to(value: Column, tolerance: float) -> Field:
    """A number that differs only beyond ``tolerance``: two values in one digest cell are never further apart."""
    return Field(value, lambda c: F.floor(c / tolerance + 0.5), lambda a, b: F.abs(a - b) > tolerance)


def current_version(rows: DataFrame, key: list[str], fields: list[str], version: str) -> DataFrame:
    """One row per key: that with the latest ``version``; a null version is oldest, among equal versions the greatest fields
    count, so that the choice never hangs on row order. Combined before the shuffle, so a key with many rows is no hot task."""
    newest = rows.groupBy(*key).agg(F.max(F.struct(version, *fields)).alias("m"))
    return newest.select(*key, *[F.col(f"m.{f}").alias(f) for f in fields])


def _xxhash(*parts: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of BIGINT columns."""
    rot = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(parts[0]), 42, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = h + _P5 + np.uint64(8)
            h = rot(h ^ (rot(p.view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _places(row: np.ndarray, third: int) -> np.ndarray:
    """The three cells of an entry: 21 bits of its row hash for each third of the table. Same arithmetic as in ``_tables``."""
    return np.stack([((row >> (21 * i)) & 0x1FFFFF) % third + i * third for i in range(_HASHES)])


def _peel(cells: pd.DataFrame, third: int) -> pd.DataFrame:
    """All entries of one subtracted table: ``key`` and ``side`` (1 left, -1 right); a row with side 0 if some didn't come out."""
    size = _HASHES * third
    count, key, row, check = (np.zeros(size, np.int64) for _ in range(4))
    at = cells["cell"].to_numpy()
    for to, name in ((count, "n"), (key, "k"), (row, "r"), (check, "c")):
        to[at] = cells[name].to_numpy()
    keys, sides = [], []
    while True:
        pure = np.flatnonzero(np.abs(count) == 1)
        pure = pure[_xxhash(key[pure], row[pure]) == check[pure]]
        if not len(pure):
            break
        _, first = np.unique(row[pure], return_index=True)
        k, r, c, s = (x[pure[first]].copy() for x in (key, row, check, count))
        keys.append(k)
        sides.append(s)
        for place in _places(r, third):
            np.subtract.at(count, place, s)
            for of, what in ((key, k), (row, r), (check, c)):
                np.bitwise_xor.at(of, place, what)
    if count.any() or key.any() or row.any():
        return pd.DataFrame({"bucket": cells["bucket"].iloc[:1].to_numpy(), "key": np.zeros(1, np.int64), "side": np.zeros(1, np.int64)})
    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return pd.DataFrame({"bucket": np.full(len(k), cells["bucket"].iloc[0] if len(cells) else 0), "key": k, "side": np.concatenate(sides) if sides else k})


def _peeler(third: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _peel(pdf, third)


def _tables(entries: DataFrame, third: int) -> DataFrame:
    """The subtracted tables' cells that aren't zero. A task of the aggregation before the shuffle sends at most as many rows as
    the buckets it holds have cells."""
    at = [((F.shiftrightunsigned("row", 21 * i).bitwiseAND(0x1FFFFF)) % third + i * third).cast("int") for i in range(_HASHES)]
    each = entries.select("bucket", "sign", "key", "row", F.xxhash64("key", "row").alias("check"), F.explode(F.array(*at)).alias("cell"))
    cells = each.groupBy("bucket", "cell").agg(F.sum("sign").alias("n"), F.bit_xor("key").alias("k"), F.bit_xor("row").alias("r"), F.bit_xor("check").alias("c"))
    return cells.where("n <> 0 or k <> 0 or r <> 0 or c <> 0")


def differing_keys(left: DataFrame, right: DataFrame, key: list[str], digests: list[str], rows_hint: int, rows_a_bucket: int = 4096, cells: int = 1023) -> DataFrame:
    """``__key`` (xxhash64 of the key): every key held by one copy only or with unequal digests. Both sides: one row per key.

    Keys are cut into buckets of about ``rows_a_bucket`` rows; of each bucket both copies fill a table of ``cells`` cells, the
    tables are subtracted and peeled. A bucket with more differences than its table can give back is done again with tables
    four and sixteen times as large, and beyond that by comparing its entries outright, so the result is always whole.
    """
    buckets = max(1, rows_hint // rows_a_bucket)
    entry = lambda df, sign: df.select(
        F.pmod(F.hash(*key), F.lit(buckets)).alias("bucket"),
        F.lit(sign).alias("sign"),
        F.xxhash64(*key).alias("key"),
        F.xxhash64(*key, *[x for d in digests for x in (F.col(d).isNull(), F.col(d))]).alias("row"),
    )
    entries = entry(left, 1).unionByName(entry(right, -1))
    found, open_ = None, None
    for factor in (1, 4, 16):
        third = cells * factor // _HASHES
        todo = entries if open_ is None else entries.join(open_, "bucket", "left_semi")
        peeled = _tables(todo, third).groupBy("bucket").applyInPandas(_peeler(third), "bucket int, key long, side long")
        peeled = cut_lineage(peeled)
        part = peeled.where("side <> 0").select(F.col("key").alias("__key"))
        found = part if found is None else found.unionByName(part)
        open_ = peeled.where("side = 0").select("bucket").distinct()
        if open_.isEmpty():
            return found.distinct()
    rest = entries.join(open_, "bucket", "left_semi").groupBy("bucket", "key", "row").agg(F.sum("sign").alias("n")).where("n <> 0")
    return found.unionByName(rest.select(F.col("key").alias("__key"))).distinct()


def reconcile(left: DataFrame, right: DataFrame, key: dict[str, Column], version: Column, fields: dict[str, Field], names: tuple[str, str] = ("left", "right"), **sizes: int) -> DataFrame:
    """``*key, finding``: one row per key held by one copy only (``only_<name>``) and per differing field of a key held by both.

    Keys, versions and values are Columns over either copy, so both must hold the columns they name; what else they hold, under
    whatever names, plays no part. Rows with a null key part can't be matched and are left out. Null against a value differs,
    null against null doesn't. Exact repeats and outdated versions count once (``current_version``). Two empty copies give no
    rows, an empty one gives the other whole.
    """
    names_ = list(key)

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[c.alias(k) for k, c in key.items()], version.alias("__v"), *[f.value.alias(f"__f_{n}") for n, f in fields.items()]).dropna(subset=names_)

    values = [f"__f_{n}" for n in fields]

    def digested(df: DataFrame) -> DataFrame:
        return current_version(shaped(df), names_, values, "__v").select(*names_, *[f.digest(F.col(f"__f_{n}")).alias(f"__d_{n}") for n, f in fields.items()])

    keys = differing_keys(digested(left), digested(right), names_, [f"__d_{n}" for n in fields], max(left.count(), right.count()), **sizes)

    def fetched(df: DataFrame, as_: str) -> DataFrame:
        near = shaped(df).withColumn("__key", F.xxhash64(*names_)).join(keys, "__key", "left_semi")
        return current_version(near, names_, values, "__v").select(*names_, F.struct(F.lit(True).alias("there"), *values).alias(as_))

    both = fetched(left, "l").join(fetched(right, "r"), names_, "full")
    findings = [F.when(F.col("r").isNull(), F.lit(f"only_{names[0]}")), F.when(F.col("l").isNull(), F.lit(f"only_{names[1]}"))]
    for n, f in fields.items():
        a, b = F.col(f"l.__f_{n}"), F.col(f"r.__f_{n}")
        unequal = (a.isNull() != b.isNull()) | F.coalesce(f.differs(a, b), F.lit(False))
        findings.append(F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & unequal, F.lit(n)))
    return both.select(*names_, F.explode(F.array_compact(F.array(*findings))).alias("finding"))
