"""A search from its text to ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import re2
from .functions.text import fnv1_64
from .operators import grep, postings, ranking
from .plans.keywords import Search, file_filter, rewrite
from .plans.trigrams import Query, trigram_query


class RefusedQuery(ValueError):
    """A query that would look at every file, or at none."""


def plan(query: str, literal: bool = False) -> tuple[Search, re2.Node, Query]:
    search = rewrite(query)
    node = re2.parse(search.query, literal)
    return search, node, trigram_query(node)


def validate(query: str, literal: bool = False) -> None:
    """Raise for an expression that is wrong or has no trigram to look up; a literal is never refused."""
    search, _, trigrams = plan(query, literal)
    if not literal and not trigrams.usable:
        raise RefusedQuery(f"the query is too short: {search.query!r}")


def query_id(query: str, literal: bool = False) -> str:
    from urllib.parse import quote_plus

    return f"{fnv1_64(f'q={quote_plus(query)}&literal={int(literal)}'.encode()):x}"


def search(files: DataFrame, query: str, *, index: postings.Index | None = None, popularity: DataFrame | None = None, literal: bool = False) -> DataFrame:
    """Ranked matching lines: docid, path, line, surroundings, pathrank, ranking, rank.

    With an index (a table, or what extracts the wanted trigrams) the trigram query, or for a case-sensitive literal of four bytes
    and more the positions of its ends, narrows the files first; without one, and for
    queries that have no trigram, all files that pass the keywords are read. The
    results are the same. Contents join the candidates last.
    """
    parsed, node, trigrams = plan(query, literal)
    wanted = files.where(file_filter(parsed, F.col("path")))
    if index is not None and trigrams.usable:
        text = node.text.encode() if re2.is_plain(node) else b""
        if len(text) >= 4 and text[:3] != b"   " and text[-3:] != b"   ":
            found = postings.phrase_positions(index, text).select("docid").distinct()
        else:
            found = postings.candidates(index, trigrams, files)
        wanted = wanted.join(found, "docid", "left_semi")
    hits = grep.grep(wanted.select("docid", "path", "content"), parsed.query, literal)
    return ranking.rank_lines(ranking.rank_files(hits, popularity, parsed), parsed)
