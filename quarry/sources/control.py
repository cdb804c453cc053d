"""Control files and installation counts as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """(fields MAP<STRING, STRING>) of a control file, plain or gzipped; continued lines belong to their field."""
    return parse_paragraphs(spark.read.option("lineSep", "\n\n").text(path))


def parse_paragraphs(texts: DataFrame, value: str = "value") -> DataFrame:
    """The same from (value) rows that hold a paragraph each."""
    joined = F.regexp_replace(F.btrim(F.col(value), F.lit("\n")), r"\n[ \t]+", "\n ")
    fields = F.regexp_extract_all(joined, F.lit(r"(?m)^([^\s:][^:\n]*):((?:[^\n]|\n )*)"), F.lit(0))
    name = lambda f: F.substring_index(f, ":", 1)
    entries = F.transform(fields, lambda f: F.struct(name(f).alias("key"), F.btrim(F.substr(f, F.length(name(f)) + 2)).alias("value")))
    latest = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return texts.where(F.btrim(F.col(value), F.lit("\n ")) != "").select(F.map_from_entries(latest).alias("fields"))


def installation_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """(binary, n) from lines "Package: name a b c d"; other lines, bad names and an architecture are dropped."""
    parts = F.split(F.btrim(F.col(value)), r"\s+")
    numbers = F.transform(F.slice(parts, 3, 4), lambda x: x.try_cast("bigint"))
    rows = lines.where(F.col(value).startswith("Package: ") & (F.size(parts) == 6)).select(F.regexp_extract(F.get(parts, F.lit(1)), r"^([A-Za-z0-9][A-Za-z0-9.+\-]*)(?::[a-z0-9\-]+)?$", 1).alias("binary"), _sum(numbers).alias("n"))
    return rows.where("binary <> '' AND n IS NOT NULL").groupBy("binary").agg(F.sum("n").alias("n"))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x)
