"""Published versions: a folder whose readers never see half a table.

A version is written beside the others, and then one small file that names it is
replaced by a rename. A job that fails leaves the former version in place; readers that
began before the swap finish on the version they opened, which is kept until the
publication after the next.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import postings

_POINTER = "CURRENT"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where none is set (a local test), a temporary one, removed with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark, "_quarry_index", None)
        if not folder:
            folder = spark._quarry_index = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the versions, the oldest first."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(path) if s.isDirectory()]
    return [name for _, name in sorted(found) if name.startswith("v-")]


def _current(spark: SparkSession, folder: str) -> str | None:
    path, fs = _fs(spark, f"{folder}/{_POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> str:
    """The path of the version that is published."""
    name = _current(spark, folder)
    if name is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return f"{folder}/{name}"


def publish(spark: SparkSession, folder: str, write: Callable[[str], object]) -> str:
    """Have ``write`` fill a new version, make it the current one, and delete those before the former one; returns its path."""
    before, name = _current(spark, folder), f"v-{uuid.uuid4().hex}"
    write(f"{folder}/{name}")
    temporary, fs = _fs(spark, f"{folder}/{_POINTER}-{name}")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    pointer, _ = _fs(spark, f"{folder}/{_POINTER}")
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, pointer, options)
    for old in _versions(spark, folder):
        if old not in (before, name):
            fs.delete(_fs(spark, f"{folder}/{old}")[0], True)
    return f"{folder}/{name}"


def publish_index(files: DataFrame, folder: str, partitions: int | None = None) -> str:
    """Publish the postings of ``files`` and, for lookups, their docids and paths."""
    spark = files.sparkSession

    def write(path: str) -> None:
        files.select("docid", "path").write.parquet(f"{path}/files")
        postings.write_index(files, f"{path}/postings", partitions)

    return publish(spark, folder, write)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The published postings."""
    return spark.read.parquet(f"{current(spark, folder)}/postings")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(docid, path) of the published index."""
    return spark.read.parquet(f"{current(spark, folder)}/files")


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(version, part, bytes, current) of all versions of an index."""
    rows, now = [], _current(spark, folder)
    for name in _versions(spark, folder):
        for part in ("files", "postings"):
            path, fs = _fs(spark, f"{folder}/{name}/{part}")
            if fs.exists(path):
                rows.append((name, part, fs.getContentSummary(path).getLength(), name == now))
    return spark.createDataFrame(rows, "version string, part string, bytes bigint, current boolean")
