"""Searches as a service runs them: started once, watched, kept for a while, cancelled."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import DataFrame

from .operators import postings, results
from .search import query_id, search, validate

#: Seconds for which a finished search answers the same query again, and how many there may be before old ones are dropped.
KEEP_S, MOST = 30 * 60, 10
#: Seconds between two reports of progress, and what chance adds to them.
REPORT_S, JITTER_S = 2.0, 0.5


class Throttle:
    """Lets the first report and the last one through, and of those between one every few seconds."""

    def __init__(self, least: float = REPORT_S, jitter: float = JITTER_S, clock: Callable[[], float] = time.monotonic):
        self.least, self.jitter, self.clock, self.next = least, jitter, clock, None

    def due(self, done: int, total: int) -> bool:
        now = self.clock()
        if done == 0 or done == total or self.next is None or now >= self.next:
            self.next = now + self.least + random.random() * self.jitter
            return True
        return False


class Running:
    """A search in a job group of its own; its ranked lines are kept on the executors' disks and memory until it is dropped."""

    def __init__(self, ranked: DataFrame, name: str, clock: Callable[[], float]):
        self.name, self.clock, self.began, self.ended, self.error, self.cancelled = name, clock, clock(), None, None, False
        self.spark = ranked.sparkSession
        self.ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
        self.found: int | None = None
        self.thread = InheritableThread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        self.spark.sparkContext.setJobGroup(self.name, "search", interruptOnCancel=True)
        try:
            self.found = self.ranked.count()
        except Exception as e:
            self.error = e
        finally:
            self.ended = self.clock()

    def wait(self, seconds: float | None = None) -> Running:
        self.thread.join(seconds)
        return self

    def progress(self) -> tuple[int, int]:
        """(tasks done, tasks in all) of the jobs so far."""
        tracker, done, total = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.name):
            for stage in (info.stageIds if (info := tracker.getJobInfo(job)) else []):
                if at := tracker.getStageInfo(stage):
                    done, total = done + at.numCompletedTasks, total + at.numTasks
        return done, total

    def watch(self, report: Callable[[int, int], None], every: float = 0.1, throttle: Throttle | None = None) -> Running:
        """Report progress, throttled, until the search has ended."""
        throttle = throttle or Throttle(clock=self.clock)
        while self.thread.is_alive():
            done, total = self.progress()
            if throttle.due(done, total):
                report(done, total)
            self.thread.join(every)
        done, total = self.progress()
        report(done if self.error else total, total)  # stages that were skipped never count as done
        return self

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.name)

    def drop(self) -> None:
        self.ranked.unpersist()

    def page(self, number: int) -> DataFrame:
        return results.checked_page(self.ranked, number)


class Session:
    """Searches of one corpus; the same query within ``keep`` seconds gets the same search, unless that failed or was cancelled."""

    def __init__(self, files: DataFrame, index: postings.Index | None = None, popularity: DataFrame | None = None, keep: float = KEEP_S, most: int = MOST, clock: Callable[[], float] = time.monotonic):
        self.files, self.index, self.popularity, self.keep, self.most, self.clock = files, index, popularity, keep, most, clock
        self.known: dict[str, Running] = {}
        self.lock = threading.Lock()

    def ask(self, query: str, literal: bool = False) -> Running:
        validate(query, literal)
        name = query_id(query, literal)
        with self.lock:
            known = self.known.get(name)
            if known and not known.error and not known.cancelled and self.clock() - known.began < self.keep:
                return known
            if known:
                self.known.pop(name).drop()
            self._collect()
            ranked = search(self.files, query, index=self.index, popularity=self.popularity, literal=literal)
            self.known[name] = Running(ranked, name, self.clock)
            return self.known[name]

    def _collect(self) -> None:
        """Drop searches that have ended, the oldest first, as long as there are too many."""
        for name, running in sorted(self.known.items(), key=lambda x: x[1].began):
            if len(self.known) < self.most:
                break
            if running.ended is not None:
                self.known.pop(name).drop()
