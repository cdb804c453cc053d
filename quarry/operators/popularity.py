"""The popularity of packages: installations and reverse dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

DEPENDENCIES = ("Depends", "Suggests", "Recommends", "Enhances")


def normalised(counts: DataFrame, by: str, count: str) -> DataFrame:
    """(by, inst): each one's share of all counts, in thousandths."""
    summed = counts.groupBy(by).agg(F.sum(count).alias("n"))
    total = summed.agg(F.sum("n").alias("total"))
    return summed.crossJoin(F.broadcast(total)).select(by, F.round(F.col("n") / F.col("total") * 1000, 6).alias("inst"))


def installations(popcon: DataFrame, owners: DataFrame) -> DataFrame:
    """(source, inst) from (binary, n) and (binary, source); binaries without a source are dropped before the total."""
    return normalised(popcon.join(owners, "binary"), "source", "n")


def dependency_names(fields: list[Column]) -> Column:
    """Distinct names in dependency fields, without alternatives' bars, architectures and version bounds."""
    parts = reduce(F.concat, [F.split(F.coalesce(f, F.lit("")), r"[,|]") for f in fields])
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"^\s*([^\s:(]*)", 1)), lambda n: n != ""))


def reverse_dependencies(packages: DataFrame, fields: tuple[str, ...] = DEPENDENCIES) -> DataFrame:
    """(name, n): how many packages name it, once each."""
    return packages.select(F.explode(dependency_names([F.col(f) for f in fields])).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def dependence(n: Column) -> Column:
    """1 - 1 / (n + 1)."""
    return 1 - 1 / (n + 1)


def package_ranking(sources: DataFrame, inst: DataFrame, reverse: DataFrame) -> DataFrame:
    """(package, inst, rdep) from sources (package, binaries "a, b"), (source, inst) and (name, n)."""
    listed = sources.select("package", F.explode(F.split("binaries", ",")).alias("binary")).withColumn("binary", F.btrim("binary"))
    summed = listed.join(reverse, listed.binary == reverse["name"], "left").groupBy("package").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    ranked = summed.join(inst.withColumnRenamed("source", "package"), "package", "left")
    return ranked.select("package", F.coalesce("inst", F.lit(0.0)).alias("inst"), F.round(dependence(F.col("n")), 6).alias("rdep"))


def write_ranking(ranking: DataFrame, folder: str) -> str:
    """Publish (package, inst, rdep) as JSON rows; readers see the former table until the new one is whole."""
    return store.publish(ranking.sparkSession, folder, lambda path: ranking.select("package", "inst", "rdep").repartitionByRange(1, "package").write.json(path))


def read_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("package string, inst double, rdep double").json(store.current(spark, folder))
