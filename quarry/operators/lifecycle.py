"""Keeping an index: what to feed and collect, when to merge, what happened."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

IDLE_S, LATEST_S = 120, 600
RETRY_S, GIVE_UP_S = 8, 25 * 60
#: How often the longer time fits into a part of a shard's requests; rows that are looked at together, or more.
SPAN, TOGETHER = 64, 1 << 16
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def missing(desired: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is to be fed: desired, but not present."""
    return desired.join(present.select(key).distinct(), key, "left_anti")


def confirmed(desired: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return desired.join(present.select(key).distinct(), key, "left_semi")


def garbage(present: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """What is to be collected: present, but no longer desired."""
    return present.join(desired.select(key).distinct(), key, "left_anti")


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups, each of which begins where ``k`` is 1; ``most`` groups at once."""
    def cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bounds = np.append(np.flatnonzero(rows.column("k").to_numpy() == 1)[::most], rows.num_rows)
        yield from (rows.slice(i, j - i) for i, j in zip(bounds[:-1], bounds[1:], strict=True))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("k").to_numpy() == 1)
        if len(begins) and sum(b.num_rows for b in held) + batch.num_rows >= TOGETHER:
            yield from cut(pa.concat_batches([*held, batch.slice(0, begins[-1])]))
            held, batch = [], batch.slice(begins[-1])
        held.append(batch)
    if held:
        yield from cut(pa.concat_batches(held))


class _Walk:
    """Requests of parts: ``base`` of each, whether it lies in its part (``own``), begins a merge whatever came before (``starts``), and where the merge that it might begin ends (``next``)."""

    def __init__(self, rows: pa.RecordBatch, span: int, idle: int, latest: int):
        self.us = rows.column("us").to_numpy()
        new = rows.column("k").to_numpy() == 1
        self.group = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.end = np.append(self.first[1:], len(new))
        at = self.us - rows.column("part").to_numpy() * span
        self.own = (at >= 0) & (at < span)
        self.starts = new | (np.diff(self.us, prepend=self.us[:1]) >= idle)
        places = np.arange(len(new) + 1)
        upcoming = np.minimum.accumulate(np.append(np.where(self.starts, places[:-1], len(new)), len(new))[::-1])[::-1][1:]
        key = self.group * _width(span, idle, latest) + at + idle
        self.next = np.minimum(np.maximum(np.searchsorted(key, key + latest), places[1:]), upcoming)

    def goes_on(self, i: np.ndarray) -> np.ndarray:
        """Whether a merge that ends before ``i`` ends by time, so that another one begins there."""
        inside = i < len(self.us)
        return inside & ~self.starts[np.where(inside, i, 0)]


def _width(span: int, idle: int, latest: int) -> int:
    return span + 2 * latest + 3 * idle + 2


def merge_triggers(requests: DataFrame, shard: str = "shard", ts: str = "ts", idle: float = IDLE_S, latest: float = LATEST_S) -> DataFrame:
    """(shard, requests, first, last, fires) of the merges that requests of each shard lead to.

    A merge runs once its shard has been idle for so long, or so long after its first
    request. What a request begins depends on the one before, so a busy shard would be a
    chain in one task. It is cut into parts of SPAN times the longer time, each with the requests around that
    a merge may reach. A part tells for each request with which a merge may enter it with which one the next
    part is entered, if it is; neighbours mostly leave alike. Only these are followed from part to part, and
    then each part lists its merges from its own way in and from each pause.
    """
    pause, most = round(idle * 1_000_000), round(latest * 1_000_000)
    span = SPAN * max(pause, most, 1)
    rows = requests.select(F.col(shard).alias("shard"), F.col(ts).cast("timestamp").alias("ts")).where("shard IS NOT NULL AND ts IS NOT NULL")
    counted = rows.groupBy("shard", F.unix_micros("ts").alias("us")).agg(F.count(F.lit(1)).alias("n"))
    part_of = lambda us: ((us - F.pmod(us, F.lit(span))) / span).cast("bigint")
    near = F.array_distinct(F.array(*[part_of(F.col("us") + shift) for shift in (-most - pause, 0, pause)]))
    parts = counted.select("shard", F.explode(near).alias("part"), "us", "n")
    numbered = F.row_number().over(Window.partitionBy("shard", "part").orderBy("us")).alias("k")
    at_once = max(1, (1 << 62) // _width(span, pause, most))
    of_shard, whole = parts.schema["shard"], lambda *names: [StructField(n, LongType()) for n in names]

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, part, entry, exit): with which request the next part is entered, null if with none, by the last of the neighbours that lead there; without an entry if a pause decides."""
        for rows in _groups(batches, at_once):
            w = _Walk(rows, span, pause, most)
            pauses = np.flatnonzero(w.starts & w.own)
            decided = np.full(len(w.first), -1)
            decided[w.group[pauses]] = pauses  # the last one of each
            open_ = np.flatnonzero(w.own & (decided[w.group] < 0) & (w.us - rows.column("part").to_numpy() * span < most + pause))
            entry = np.concatenate((decided[decided >= 0], open_))
            fixed = np.arange(len(entry)) < (decided >= 0).sum()
            now, going = entry.copy(), np.ones(len(entry), dtype=bool)
            while going.any():
                now[going] = w.next[now[going]]
                going &= w.goes_on(now)
                going[going] = w.own[now[going]]
            out = np.where(w.goes_on(now), now, -1)
            kept = ~fixed | (out >= 0)
            kept[:-1] &= fixed[:-1] | fixed[1:] | (out[:-1] != out[1:]) | (w.group[entry[:-1]] != w.group[entry[1:]])  # the last of those that leave alike
            entry, fixed, out = entry[kept], fixed[kept], out[kept]
            yield pa.RecordBatch.from_arrays([rows.column("shard").take(pa.array(entry)), rows.column("part").take(pa.array(entry)), pa.array(w.us[entry], mask=fixed), pa.array(w.us[out], mask=out < 0)], ["shard", "part", "entry", "exit"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, part, entry): with which request a merge really enters a part."""
        at = value = done = None
        for batch in batches:
            taken, into = [], []
            for i, (k, part, entry, out) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("k", "part", "entry", "exit")], strict=True)):
                if k == 1:
                    at = value = done = None
                if part != done and (entry is None or part == at and entry >= value):
                    at, value, done = None if out is None else part + 1, out, part
                    if out is not None:
                        taken.append(i)
                        into.append((at, value))
            columns = [batch.column("shard").take(pa.array(taken, pa.int64())), *[pa.array([x[j] for x in into], pa.int64()) for j in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "entry"])

    def merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, at_once):
            w = _Walk(rows, span, pause, most)
            before = np.concatenate(([0], np.cumsum(rows.column("n").to_numpy())))
            entered = rows.column("entry").fill_null(np.iinfo(np.int64).min).to_numpy() == w.us
            now = np.flatnonzero(w.own & (w.starts | entered))
            while len(now):
                end = w.next[now]
                yield pa.RecordBatch.from_arrays([rows.column("shard").take(pa.array(now)), pa.array(before[end] - before[now]), pa.array(w.us[now]), pa.array(w.us[end - 1])], ["shard", "requests", "first", "last"])
                now = end[w.goes_on(end)]
                now = now[w.own[now]]

    table = parts.select("shard", "part", "us", "n", numbered).mapInArrow(ways, StructType([of_shard, *whole("part", "entry", "exit")]))
    in_order = F.row_number().over(Window.partitionBy("shard").orderBy("part", F.asc_nulls_first("entry"))).alias("k")
    entries = table.select("shard", "part", "entry", "exit", in_order).mapInArrow(follow, StructType([of_shard, *whole("part", "entry")]))
    found = parts.join(entries, ["shard", "part"], "left").select("shard", "part", "us", "n", "entry", numbered).mapInArrow(merges, StructType([of_shard, *whole("requests", "first", "last")]))
    fires = F.least(F.col("last") + pause, F.col("first") + most)
    return found.select("shard", "requests", *[F.timestamp_micros(c).alias(name) for c, name in ((F.col("first"), "first"), (F.col("last"), "last"), (fires, "fires"))])


def retry_times(first: float = RETRY_S, limit: float = GIVE_UP_S) -> list[float]:
    """Waits between tries for a file that isn't there yet: each twice the one before, as long as all together stay below the limit."""
    out: list[float] = []
    while sum(out) + first * 2 ** len(out) < limit:
        out.append(first * 2 ** len(out))
    return out


def latest_events(events: DataFrame, by: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The last event of each kind; earlier ones are obsolete."""
    last = F.max_by(F.struct(*payload), F.struct(*order))
    return events.groupBy(*by).agg(last.alias("last")).select(*by, "last.*")


def numbered(events: DataFrame, query: str, order: list[str]) -> DataFrame:
    """Events with their sequence numbers, from 0, within each query, as a late reader replays them."""
    from pyspark.sql import Window

    return events.withColumn("seq", F.row_number().over(Window.partitionBy(query).orderBy(*order)) - 1)


def bucket_of(seconds: Column) -> Column:
    """Index of the histogram bucket: the first bound that isn't below the value, the number of bounds beyond the last."""
    out = F.when(seconds.isNull(), None)
    for i, bound in enumerate(BUCKETS):
        out = out.when(seconds <= bound, i)
    return out.otherwise(len(BUCKETS))


def histogram(values: DataFrame, column: str) -> DataFrame:
    """(bucket, n, total)."""
    rows = values.where(F.col(column).isNotNull()).select(bucket_of(F.col(column)).alias("bucket"), F.col(column).alias("v"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


def clicks(events: DataFrame, most: int = 4096) -> DataFrame:
    """(value) lines for an append-only click log: those with a path and a line, each cut to ``most`` bytes at a character's end."""
    rows = events.where("path IS NOT NULL AND path <> '' AND line IS NOT NULL").select(F.to_json(F.struct(*events.columns)).alias("value"))
    return rows.select(F.when(F.octet_length("value") <= most, F.col("value")).otherwise(F.make_valid_utf8(F.substring(F.col("value").cast("binary"), 1, most).cast("string"))).alias("value"))


def index_sizes(files: DataFrame, by: str) -> DataFrame:
    """(by, files, bytes)."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
