"""Pages, groups and counts of results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import package_of, release_of
from ..functions.versions import sort_key
from .ranking import total_order

PAGE, PACKAGES, PER_PACKAGE, SHOWN = 10, 5, 2, 100
#: Results up to which a page is merged from the best of each task; a later one is located by counts first.
SHALLOW = 100
_COLUMNS = ("path", "line", "ctxp2", "ctxp1", "context", "ctxn1", "ctxn2", "rank")


def top(ranked: DataFrame, n: int = PAGE) -> DataFrame:
    return ranked.orderBy(*total_order()).limit(n)


def _place() -> tuple[Column, Column]:
    """The first terms of the total order, both descending: the rank and three digits of the path's hash, nulls the least."""
    return F.coalesce("rank", F.lit(float("-inf"))).alias("rank"), F.coalesce(F.substring(F.md5("path"), 1, 3), F.lit("")).alias("hash")


@contextmanager
def places(ranked: DataFrame) -> Iterator[DataFrame]:
    """(rank, hash, n): how many results lie at each place of the order, kept while pages are located by them; the search runs once for them."""
    counts = ranked.groupBy(*_place()).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        yield counts
    finally:
        counts.unpersist()


def pages(counts: DataFrame, size: int = PAGE) -> int:
    return -(-(counts.agg(F.sum("n")).first()[0] or 0) // size)


def _holding(counts: DataFrame, keys: list[str], first: int, size: int):
    """(low, high, before): the least and the greatest ``keys`` that hold the results from ``first`` on, and how many results precede them."""
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    through = F.sum("n").over(Window.partitionBy().orderBy(*map(F.desc, keys)).rowsBetween(Window.unboundedPreceding, 0))
    held = sums.withColumn("before", through - F.col("n")).where((F.col("before") + F.col("n") > first) & (F.col("before") < first + size))
    return held.agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"), F.min("before").alias("before")).first()


def page(ranked: DataFrame, number: int, size: int = PAGE, counts: DataFrame | None = None) -> DataFrame:
    """Page ``number``, from 0; the one after the last is empty.

    To skip many results in one task, it would have to read them all. So a late page is located
    first, by ``counts`` of :func:`places`: by rank, then among the ranks that hold it by hash.
    Only what shares these with it is sorted.
    """
    first = number * size
    if first + size <= SHALLOW:
        return ranked.orderBy(*total_order()).offset(first).limit(size)
    if counts is None:
        with places(ranked) as counts:
            return page(ranked, number, size, counts)
    by_rank = _holding(counts, ["rank"], first, size)
    if by_rank.low is None:
        return ranked.where(F.lit(False))
    near = counts.where(F.col("rank").between(by_rank.low.rank, by_rank.high.rank))
    held = _holding(near, ["rank", "hash"], first - by_rank.before, size)
    bound = lambda x: F.struct(F.lit(x.rank).alias("rank"), F.lit(x.hash).alias("hash"))
    kept = ranked.where(F.struct(*_place()).between(bound(held.low), bound(held.high)))
    return kept.orderBy(*total_order()).offset(first - by_rank.before - held.before).limit(size)


class NoSuchPage(LookupError):
    """A page beyond the one after the last."""


def checked_page(ranked: DataFrame, number: int, size: int = PAGE, counts: DataFrame | None = None) -> DataFrame:
    """Page ``number`` as :func:`page` gives it; NoSuchPage for a negative one and for one beyond the empty page after the last."""
    if counts is None:
        with places(ranked) as counts:
            return checked_page(ranked, number, size, counts)
    last = pages(counts, size)
    if not 0 <= number <= last:
        raise NoSuchPage(f"page {number} of {last}")
    return page(ranked, number, size, counts)


def shown_packages(ranked: DataFrame, limit: int = SHOWN) -> DataFrame:
    """The first packages, by name, that a result page links to."""
    return packages_with_results(ranked, limit)


def shown_lines(ranked: DataFrame) -> DataFrame:
    """(path, line, before ARRAY, context, after ARRAY) as a page shows them: four blanks for each leading tab, no blank lines around."""
    def shown(line: Column) -> Column:
        tabs = F.regexp_extract(line, r"^\t*", 0)
        return F.concat(F.repeat(F.lit("    "), F.length(tabs)), F.substr(line, F.length(tabs) + 1))

    lines = lambda *names: F.transform(F.filter(F.array(*map(F.col, names)), lambda x: F.btrim(x, F.lit(" \t\r")) != ""), shown)
    return ranked.select("path", "line", lines("ctxp2", "ctxp1").alias("before"), shown(F.col("context")).alias("context"), lines("ctxn1", "ctxn2").alias("after"))


def page_counts(ranked: DataFrame) -> DataFrame:
    """(results, pages, packages, package_pages)."""
    counted = ranked.agg(F.count(F.lit(1)).alias("results"), F.countDistinct(release_of(F.col("path"))).alias("packages"))
    return counted.select("results", F.ceil(F.col("results") / PAGE).alias("pages"), "packages", F.ceil(F.col("packages") / PACKAGES).alias("package_pages"))


def newest_versions(files: DataFrame) -> DataFrame:
    """(package, version): the greatest version of each package by version order; invalid ones don't count."""
    rows = files.select("package", "version").distinct().withColumn("key", sort_key(F.col("version")))
    return rows.where("key IS NOT NULL").groupBy("package").agg(F.max_by("version", F.struct("key", "version")).alias("version"))


def newest_only(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results that lie in the newest version of their package; equal versions count as one however they are written."""
    newest = newest_versions(files).select(F.col("package").alias("__package"), sort_key(F.col("version")).alias("__key"))
    version = F.regexp_extract(release_of(F.col("path")), r"^[^_]*_(.*)$", 1)
    joined = results.join(newest, package_of(F.col("path")) == F.col("__package"))
    return joined.where(sort_key(version) == F.col("__key")).select(*[results[c] for c in results.columns])


def per_package(ranked: DataFrame, n: int = PER_PACKAGE) -> DataFrame:
    """(package, best, results ARRAY): the best ``n`` results of each release, in order."""
    package = release_of(F.col("path"))
    columns = [c for c in _COLUMNS if c in ranked.columns]
    of = Window.partitionBy("package").orderBy(*total_order())
    best = ranked.select(package.alias("package"), *columns).withColumn("n", F.row_number().over(of)).where(F.col("n") <= n)
    listed = best.groupBy("package").agg(F.max("rank").alias("best"), F.sort_array(F.collect_list(F.struct("n", *columns))).alias("results"))
    return listed.withColumn("results", F.transform("results", lambda r: F.struct(*[r[c].alias(c) for c in columns])))


def package_page(ranked: DataFrame, number: int, size: int = PACKAGES) -> DataFrame:
    """Page ``number`` of packages, the best first, then by name."""
    return per_package(ranked).orderBy(F.desc("best"), "package").offset(number * size).limit(size)


def packages_with_results(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    found = ranked.select(release_of(F.col("path")).alias("package")).distinct().orderBy("package")
    return found.limit(limit) if limit else found


def occurrences(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def api_rows(ranked: DataFrame) -> DataFrame:
    """(package, path, line, context_before, context, context_after), without the empty lines around."""
    lines = lambda *names: F.filter(F.array(*map(F.col, names)), lambda x: x != "")
    return ranked.select(release_of(F.col("path")).alias("package"), "path", "line", lines("ctxp2", "ctxp1").alias("context_before"), "context", lines("ctxn1", "ctxn2").alias("context_after"))


def as_json(rows: DataFrame) -> DataFrame:
    """(value): a JSON object a row, as ``write.text`` takes it."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
