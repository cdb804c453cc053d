"""Ranks of files and of matching lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.re2 import java, parse
from ..functions.text import leading_spaces, package_of
from ..plans.keywords import Search, suffix_weight

INSTALLED, DEPENDED = 0.3840, 0.3427
PATH, PACKAGE = 0.1460, 0.0008
#: What a line's rank weighs against the best file's.
LINE = 0.1
DIGITS = 6


def _patterns(query: str) -> tuple[str, str]:
    bare = query.replace("(?i)", "", 1)
    anywhere = java(parse("(?i)" + "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c if c.isprintable() and c != " " else c for c in bare)))
    word = java(parse(r"\b"))
    return word + anywhere + word, anywhere


def _place(text: Column, pattern: str) -> Column:
    """Share of the text that lies before the first match, in bytes; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.octet_length(F.substr(text, F.lit(1), at - 1)) / F.greatest(F.octet_length(text), F.lit(1)))


def name_match(query: str, text: Column) -> Column:
    """How well a query matches a name: as a word from 0.75, else anywhere from 0.5, more the earlier it stands."""
    word, anywhere = _patterns(query)
    return F.coalesce(0.75 + 0.25 * (1 - _place(text, word)), 0.5 + 0.25 * (1 - _place(text, anywhere)), F.lit(0.5))


def line_match(query: str, line: Column) -> Column:
    """Rank of a line: less the deeper it is indented, and half if the query isn't a word of it."""
    word, _ = _patterns(query)
    return (1 - leading_spaces(line) / 100) * F.coalesce(0.75 + 0.25 * (1 - _place(line, word)), F.lit(0.5))


def rank_files(files: DataFrame, popularity: DataFrame | None, search: Search) -> DataFrame:
    """The columns of ``files`` and ``pathrank``; packages without popularity count 0.

    ``popularity`` has (package, inst, rdep), a row a package: some ten thousand short rows. It is
    broadcast, as a shuffle would bring all hits of a large package, with their lines, to one task.
    """
    package = package_of(F.col("path"))
    if popularity is None:
        rows, inst, rdep = files, F.lit(0.0), F.lit(0.0)
    else:
        known = popularity.select(F.col("package").alias("__package"), "inst", "rdep")
        rows = files.join(F.broadcast(known), package == F.col("__package"), "left")
        inst, rdep = F.coalesce("inst", F.lit(0.0)), F.coalesce("rdep", F.lit(0.0))
    rank = 1 + suffix_weight(search, F.col("path")) + INSTALLED * inst + DEPENDED * rdep
    rank = rank + PATH * name_match(search.query, F.col("path")) + PACKAGE * name_match(search.query, package)
    return rows.select(*[files[c] for c in files.columns], F.round(rank, DIGITS).alias("pathrank"))


def rank_lines(hits: DataFrame, search: Search) -> DataFrame:
    """Adds ``ranking`` of the line and ``rank``: the file's and, scaled by the best file of all, the line's.

    The best is taken from the same shuffled hits that it scales: its maximum runs
    over whole rows, so both read one exchange and the texts are searched once.
    """
    ranked = hits.withColumn("ranking", F.round(line_match(search.query, F.col("context")), DIGITS)).hint("rebalance")
    best = ranked.agg(F.max(F.struct("pathrank", *[c for c in ranked.columns if c != "pathrank"])).alias("top")).select(F.col("top.pathrank").alias("best"))
    return ranked.crossJoin(F.broadcast(best)).withColumn("rank", F.round(F.col("pathrank") + F.col("best") * LINE * F.col("ranking"), DIGITS)).drop("best")


def candidate_order() -> list[Column]:
    """The order in which candidate files are read: the best first, then by path, descending."""
    return [F.desc("pathrank"), F.desc("path")]


def total_order() -> list[Column]:
    """The order of results; ties in rank go by a hash of the path, which mixes packages, then by path and line."""
    return [F.desc("rank"), F.desc(F.md5("path")), F.asc("path"), F.asc("line")]
