"""Frame streams: fixed-rate triggers, newest frames, rate-limited side outputs, and switches at run time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def trigger_ms(fps: float) -> int:
    """Interval of a fixed rate, whole milliseconds, at least 1."""
    return max(1, int(1000 / fps))


def latest_only(frames: DataFrame, entity: str, ts: str) -> DataFrame:
    """The newest frame of each entity in a (micro-)batch: what a device buffer of one leaves."""
    names = frames.columns
    newest = frames.groupBy(F.col(entity).alias("__e")).agg(F.max_by(F.struct(*names), F.col(ts)).alias("m"))
    return newest.select("m.*")


def cooldown_stream(frames: DataFrame, entity: str, frame: str, ts: str, completed: Column, cooldown_s: float = 2.0) -> DataFrame:
    """``entity, frame, ts, completed`` of the sampled frames of a stream; gives what ``operators.cooldown`` gives on the same rows,
    as long as an entity's frames arrive in order of time.

    State per entity: the time of the last sampled frame that completed. Frames of one trigger are taken in order of time and id;
    null entities, frames and times are left out.
    """
    rows = frames.select(F.col(entity).alias("entity"), F.col(frame).alias("frame"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(completed, F.lit(False)).alias("completed")).dropna()
    limit = pd.Timedelta(seconds=cooldown_s).value

    def sample(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        batch = pd.concat(list(batches)).drop_duplicates("frame").sort_values(["ts", "frame"])
        keep = []
        for t, done in zip(batch["ts"].astype("datetime64[ns]").astype("int64"), batch["completed"]):
            fits = last is None or t - last >= limit
            keep.append(fits)
            if fits and done:
                last = int(t)
        if last is not None:
            state.update((last,))
        yield batch[keep]

    out = rows.groupBy("entity").applyInPandasWithState(sample, "entity STRING, frame STRING, ts TIMESTAMP, completed BOOLEAN", "last LONG", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnsRenamed({"entity": entity, "frame": frame, "ts": ts})


def clear_on_empty(frames: DataFrame, detections: str, label: Column) -> DataFrame:
    """``label`` as it is where the frame has detections, null where it has none (the display is then cleared)."""
    return frames.withColumn("label", F.when(F.size(detections) > 0, label))


class Controls:
    """Switches of a running stream: a change stops the query and starts it again from its checkpoint with the new settings."""

    def __init__(self, start: Callable[[dict[str, Any]], StreamingQuery], **settings: Any) -> None:
        self._start, self.settings = start, settings
        self.query: StreamingQuery | None = None

    def run(self) -> StreamingQuery:
        self.query = self._start(dict(self.settings))
        return self.query

    def change(self, **settings: Any) -> StreamingQuery:
        """New settings; what isn't named stays. Nothing restarts if nothing changed."""
        if self.query is not None and self.query.isActive:
            if settings.items() <= self.settings.items():
                return self.query
            self.query.stop()
        self.settings |= settings
        return self.run()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
