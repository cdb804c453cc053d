"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (left, right); a component is named by its least node."""
    return members(components_table(edges).df)


def components_table(edges: DataFrame) -> Table:
    """The components as stars: (u, v) with v the least node of u's component, for all other nodes u of it.

    Alternates large-star and small-star steps until the edges are stars, which
    takes a number of rounds logarithmic in the longest path. Minima are joined
    back rather than neighbour lists collected, so a node of millions of edges is
    an aggregate like any other. Each round is written, which cuts the lineage;
    the last but one is deleted.
    """
    ordered = edges.select(F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v")).where("u <> v").distinct()
    now = Table(ordered, "edges")
    stamp = _stamp(now.df)
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        middle = Table(large, "edges")
        down = middle.df.groupBy("u").agg(F.min("v").alias("m"))
        small = middle.df.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = Table(small, "edges")
        middle.drop()
        now.drop()
        now, before, stamp = then, stamp, _stamp(then.df)
        if stamp == before:
            break
    return now


def members(stars: DataFrame) -> DataFrame:
    """(node, component) from stars (u, v)."""
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
