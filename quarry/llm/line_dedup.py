"""Line dedup by site-relative frequency (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Table

#: A line on more than this share of a site's pages is boilerplate of the site.
RATIO = 0.02
#: The least number of pages on which a line repeats at all; beyond it the ratio alone decides, on sites of any size.
REPEATED = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """Per site, the hashes of its boilerplate lines: (site, lines ARRAY<BIGINT>).

    Only (site, line hash) pairs are shuffled, once per page and after map-side
    counting. A site has at most (lines per page) / ratio boilerplate lines, so
    each array stays small however many pages the site has.
    """
    pages = docs.select(F.col(site).alias("site"), F.col(text).alias("text")).where("site IS NOT NULL")
    total = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda line: F.trim(line) != ""), _key))
    seen = pages.select("site", F.explode(keys).alias("line")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = seen.where(F.col("n") >= REPEATED).join(total, "site").where(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def line_dedup(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """Drop from each text the lines that are on more than a share of ``ratio`` of its site's pages, and on two at least.

    Returns the columns of ``docs`` with the text replaced, and ``dropped_lines``
    (BIGINT), which replaces an input column of that name. Lines are compared
    without surrounding spaces; blank lines always stay. Every row is a page, so
    repeated rows count each. A row whose site is null belongs to no site and a
    null text has no lines: both come back unchanged, with 0 dropped lines. A text
    all of whose lines go becomes the empty string, as both of two equal pages of a
    small site do. Texts of any length count whole, columns may have any names, and
    sites any type. Empty input gives empty output.

    The boilerplate table is written first; Spark then sees its size and
    broadcasts it only below the session's threshold, and otherwise joins by
    site, where AQE splits a hot site.
    """
    table = Table(boilerplate(docs, site, text, ratio), "boilerplate").df
    joined = docs.select(F.struct("*").alias("row")).join(table.select(F.struct("*").alias("bad")), F.col(f"row.`{site}`") == F.col("bad.site"), "left")
    kept = F.filter(_lines(F.col(f"row.`{text}`")), lambda line: ~F.array_contains(F.col("bad.lines"), _key(line)) | (F.trim(line) == ""))
    changed = F.col("bad").isNotNull() & F.col(f"row.`{text}`").isNotNull()
    before = F.size(_lines(F.col(f"row.`{text}`")))
    step = joined.select("row", F.when(changed, kept).alias("kept"), F.when(changed, before).alias("before"))
    others = [c for c in docs.columns if c != "dropped_lines"]
    return step.select(
        *[(F.when(F.col("kept").isNull(), F.col(f"row.`{c}`")).otherwise(F.array_join("kept", "\n")) if c == text else F.col(f"row.`{c}`")).alias(c) for c in others],
        F.coalesce(F.col("before") - F.size("kept"), F.lit(0)).cast("bigint").alias("dropped_lines"),
    )


#: The same in DuckDB, over ``documents`` with its source as the site.
SQL = f"""
WITH lines AS (
  SELECT doc_id, source, i, line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT source, trim(line) AS line FROM lines JOIN pages USING (source) WHERE trim(line) <> ''
  GROUP BY source, trim(line)
  HAVING count(DISTINCT doc_id) >= {REPEATED} AND count(DISTINCT doc_id) > {RATIO} * any_value(pages)),
kept AS (
  SELECT doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS text,
         count(*) FILTER (WHERE b.line IS NOT NULL) AS dropped_lines
  FROM lines l LEFT JOIN bad b ON b.source = l.source AND b.line = trim(l.line) GROUP BY doc_id)
SELECT doc_id, text, dropped_lines FROM kept
"""
