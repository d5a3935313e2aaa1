"""Rate-limited sampling of an ordered stream: at most one side output per cooldown, as a batch operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.runtime import cut_lineage, micros


def _whole_groups(keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by ``keys`` to ``work`` of frames that hold every group whole; one group and one batch are held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            same = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
            first = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
            if first or (held and not (batch[keys].iloc[0] == held[-1][keys].iloc[-1]).all()):
                ready = pd.concat([*held, batch.iloc[:first]])
                held = []
                if len(ready):
                    yield work(ready)
            held.append(batch.iloc[first:])
        if held:
            yield work(pd.concat(held))

    return run


def _slices(frame: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
    first = np.flatnonzero(new)
    return zip(first, np.append(first[1:], len(frame)))


def _following(u: np.ndarray, limit: int) -> np.ndarray:
    """Index of the first time at least ``limit`` after each, and behind it; the length where there is none."""
    return np.maximum(np.searchsorted(u, u + limit, side="left"), np.arange(len(u)) + 1)


def _exits(limit: int, step: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per bucket: for each completed frame from which the clock can run on, the last one at which it then stands."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lo, hi in _slices(frame, ["e", "b"]):
            e, b, u = frame["e"].iat[lo], int(frame["b"].iat[lo]), frame["u"].to_numpy()[lo:hi][frame["c"].to_numpy()[lo:hi]]
            n = len(u)
            at = _following(u, limit)
            at = np.where(at < n, at, np.arange(n))
            while (jump := at[at] if n else at).tolist() != at.tolist():
                at = jump
            start = np.flatnonzero(np.append([True], u[:-1] < b * step + limit)[:n])
            out.append(pd.DataFrame({"e": e, "b": b, "s": u[start], "x": u[at[start]]}) if n else pd.DataFrame({"e": [e], "b": [b], "s": pd.array([None], "Int64"), "x": pd.array([None], "Int64")}))
        return pd.concat(out).astype({"s": "Int64", "x": "Int64"})

    return work


def _chained(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per entity: the time at which the clock stands before each bucket."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        out, now, entity = [], None, None
        for lo, hi in _slices(frame, ["e", "b"]):
            if frame["e"].iat[lo] != entity:
                entity, now = frame["e"].iat[lo], None
            out.append((entity, int(frame["b"].iat[lo]), now))
            if not pd.isna(frame["s"].iat[lo]):
                starts = frame["s"].to_numpy()[lo:hi].astype(np.int64)
                k = 0 if now is None else int(np.searchsorted(starts, now + limit, side="left"))
                now = int(frame["x"].iat[lo + k]) if k < len(starts) else now
        return pd.DataFrame(out, columns=["e", "b", "before"]).astype({"before": "Int64"})

    return work


def _sampled(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The sampled frames of whole buckets, of which ``before`` tells where the clock stood."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        keep = np.zeros(len(frame), bool)
        for lo, hi in _slices(frame, ["e", "b"]):
            u, done = frame["u"].to_numpy()[lo:hi], np.flatnonzero(frame["c"].to_numpy()[lo:hi])
            before = frame["before"].iat[lo]
            known, times = not pd.isna(before), u[done]
            after, chain = _following(times, limit), []
            i = int(np.searchsorted(times, int(before) + limit, side="left")) if known else 0
            while i < len(times):
                chain.append(done[i])
                i = after[i]
            chain = np.array(chain, np.int64)
            k = np.searchsorted(chain, np.arange(hi - lo), side="left") - 1
            clock = np.where(k >= 0, u[chain[np.maximum(k, 0)]] if len(chain) else 0, int(before) if known else 0)
            keep[lo:hi] = ((k < 0) & (not known)) | (u - clock >= limit)
        return frame.loc[keep, ["e", "f", "t", "c"]]

    return work


def cooldown_samples(frames: DataFrame, entity: str, frame: str, ts: str, completed: Column, cooldown_s: float = 2.0, bucket_s: int = 3600) -> DataFrame:
    """``entity, frame, ts, completed`` of the frames that are sampled.

    A frame is sampled if ``cooldown_s`` have passed since the last sampled frame that also **completed** (a frame that ends early
    is sampled but leaves the clock alone). An entity's frames are cut into time buckets. How a bucket moves the clock is worked
    out for every place at which it can enter (the completed frames of the first cooldown), all buckets in parallel; these few
    rows are chained along the entity, and then every bucket samples by itself. A task holds one bucket's frames at a time, so
    an entity that never pauses, with any number of rows, is many tasks.

    Null entities, frames and times are left out; a null ``completed`` is false; equal times are ordered by frame id; exact
    repeats of a frame count once.
    """
    rows = frames.select(F.col(entity).alias("e"), F.col(frame).alias("f"), micros(F.col(ts)).alias("u"), F.col(ts).alias("t"), F.coalesce(completed, F.lit(False)).alias("c"))
    rows = rows.where("e is not null and f is not null and u is not null").groupBy("e", "f").agg(F.min(F.struct("u", "t", "c")).alias("m")).select("e", "f", "m.*")
    limit, step = int(cooldown_s * 1_000_000), bucket_s * 1_000_000
    rows = cut_lineage(rows.withColumn("b", F.floor(F.col("u") / step).cast("bigint")).repartition("e", "b").sortWithinPartitions("e", "b", "u", "f"))
    kind = lambda c: rows.schema[c].dataType.simpleString()

    exits = rows.select("e", "b", "u", "c").sortWithinPartitions("e", "b", "u").mapInPandas(_whole_groups(["e", "b"], _exits(limit, step)), f"e {kind('e')}, b bigint, s bigint, x bigint")
    before = exits.repartition("e").sortWithinPartitions("e", "b", "s").mapInPandas(_whole_groups(["e"], _chained(limit)), f"e {kind('e')}, b bigint, before bigint")
    told = rows.join(before, ["e", "b"]).repartition("e", "b").sortWithinPartitions("e", "b", "u", "f").select("e", "b", "u", "f", "t", "c", "before")
    kept = told.mapInPandas(_whole_groups(["e", "b"], _sampled(limit)), f"e {kind('e')}, f {kind('f')}, t {kind('t')}, c boolean")
    return kept.withColumnsRenamed({"e": entity, "f": frame, "t": ts, "c": "completed"})
