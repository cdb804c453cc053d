"""Intermediate tables in the folder that all executors share.

Operators that need a result twice, or that must cut a long lineage, write it as
Parquet below ``spark.checkpoint.dir`` and read it back: a lost executor then
costs a reread and no recomputation, the files are compressed, and Spark knows
their size when it chooses between a broadcast and a shuffled join.

Tables live as long as something may read them: an operator drops those that only
led to a later one, :func:`scope` drops what was made inside it, and the rest goes
when the Python process ends, or with :func:`release`.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[Table] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set (a local test), a temporary one, removed with the process."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = getattr(spark, "_quarry_folder", None)
        if not folder:
            folder = spark._quarry_folder = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


class Table:
    """A written DataFrame: ``df`` reads it, ``drop()`` deletes its files; ``after`` are tables that nothing needs once it is written.

    It is written in a session of its own, a clone, in which Spark is told to delete
    the shuffles that led to it right then rather than when the driver's garbage is collected.
    """

    def __init__(self, df: DataFrame, name: str, after: tuple[Table, ...] | list[Table] = ()):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/quarry/{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        own = self.spark._jsparkSession.cloneSession()
        own.conf().set(_CLEAN_UP, "true")
        same = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.queryExecution().logical())
        same.write().parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _made.append(self)
        for table in after:
            table.drop()

    def size(self) -> int:
        """Bytes on disk."""
        path, fs = self._hadoop()
        return fs.getContentSummary(path).getLength()

    def drop(self) -> None:
        path, fs = self._hadoop()
        fs.delete(path, True)
        if self in _made:
            _made.remove(self)

    def _hadoop(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


@contextmanager
def scope(*kept: str) -> Iterator[None]:
    """Drop the tables made inside, but for those whose names begin with one of ``kept``."""
    before = list(_made)
    try:
        yield
    finally:
        for table in [t for t in _made if t not in before and not t.path.rpartition("/")[2].startswith(kept or "\0")]:
            table.drop()


def release() -> None:
    """Drop all tables of this process whose session still runs."""
    for table in list(_made):
        if table.spark.sparkContext._jsc is not None:
            table.drop()


@atexit.register
def _end() -> None:
    try:
        release()
    except Exception:  # the session has gone before; its folder is named by the application's id
        _made.clear()
