"""Structured Streaming forms of ingest, the event log and merge triggers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import IDLE_S, LATEST_S
from ..operators.postings import postings


def ingest(files: DataFrame, index_folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the postings of arriving files to an index; the file sink's log makes each batch appear once or not at all."""
    writer = postings(files).writeStream.format("parquet").option("path", index_folder).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()


def latest_events(events: DataFrame, by: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """A stream of the newest event of each kind, for a sink in update or complete mode."""
    last = F.max_by(F.struct(*payload), F.struct(*order))
    return events.groupBy(*by).agg(last.alias("last")).select(*by, "last.*")


def merge_triggers(requests: DataFrame, shard: str = "shard", ts: str = "ts", lateness: str = "10 seconds", idle: float = IDLE_S, latest: float = LATEST_S) -> DataFrame:
    """(shard, requests, first, last) of merges as they fall due by the watermark.

    A shard's state is three numbers for each pending merge: its first and last request
    and their count, of which there are few however many requests come. A late request joins the
    pending merge whose time it lies in; what is due leaves the state.
    """
    rows = requests.select(F.col(shard).cast("string").alias("shard"), F.col(ts).alias("ts")).withWatermark("ts", lateness)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = [list(x) for x in zip(*state.get, strict=True)] if state.exists else []
        for frame in frames:
            times, counts = np.unique(pd.to_datetime(frame["ts"]).astype("datetime64[us]").astype("int64").to_numpy() / 1e6, return_counts=True)
            pending = joined(sorted(pending + [[t, t, int(n)] for t, n in zip(times.tolist(), counts.tolist(), strict=True)]), idle, latest)
        now = state.getCurrentWatermarkMs() / 1000
        fires = [min(last + idle, first + latest) for first, last, _ in pending]
        due = [(key[0], n, pd.Timestamp(first, unit="s"), pd.Timestamp(last, unit="s")) for (first, last, n), f in zip(pending, fires, strict=True) if f <= now]
        kept = [(m, f) for m, f in zip(pending, fires, strict=True) if f > now]
        if kept:
            state.update(tuple(map(list, zip(*[m for m, _ in kept], strict=True))))
            state.setTimeoutTimestamp(max(int(now * 1000) + 1, int(min(f for _, f in kept) * 1000)))
        elif state.exists:
            state.remove()
        if due:
            yield pd.DataFrame(due, columns=["shard", "requests", "first", "last"])

    return rows.groupBy("shard").applyInPandasWithState(step, "shard string, requests bigint, first timestamp, last timestamp", "first array<double>, last array<double>, n array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def joined(merges: list[list], idle: float, latest: float) -> list[list]:
    """Ascending [first, last, count] put together as long as neither the pause before one nor the age of the first ends the merge."""
    out: list[list] = []
    for first, last, n in merges:
        if out and first - out[-1][1] < idle and first - out[-1][0] < latest and last - out[-1][0] < latest:
            out[-1] = [out[-1][0], max(last, out[-1][1]), out[-1][2] + n]
        else:
            out.append([first, last, n])
    return out
