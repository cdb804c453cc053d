"""Matching lines with their surroundings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import re2


def text_lines(content: Column) -> Column:
    """Lines without their newlines; what follows the last newline is a line only if there is something, or nothing else."""
    parts = F.split(content, "\n")
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _lines_of_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the distinct lines, from 1, of each text's byte offsets: its newlines are found once, the places among them by binary search."""
    for batch in batches:
        found = []
        for content, places in zip(batch.column("content"), batch.column("places"), strict=True):
            newlines = np.flatnonzero(np.frombuffer(content.as_buffer(), dtype=np.uint8) == 10)
            found.append(np.unique(np.searchsorted(newlines, places.values.to_numpy(), side="left") + 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("docid"), batch.column("content"), pa.array(found, pa.list_(pa.int32()))], ["docid", "content", "at"])


def grep(files: DataFrame, pattern: str, literal: bool = False, content: str = "content") -> DataFrame:
    """A row for each line that matches: the columns of ``files`` but the content, and line, ctxp2, ctxp1, context, ctxn1, ctxn2.

    Whole texts are first tried at once, which needs no array of lines; only those
    with a match are split. Surrounding lines that don't exist are empty. A null text has no line.
    Columns of ``files`` may have any names; those named like an output are replaced by it.
    """
    node = re2.parse(pattern, literal)
    whole = "(?s)" + re2.java(node, whole=True)
    kept = [c for c in files.columns if c != content and c not in ("line", "ctxp2", "ctxp1", "context", "ctxn1", "ctxn2")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0))
    rows = files.where(F.col(content).rlike(whole)).select(row.alias("row"), text_lines(F.col(content)).alias("lines"), F.col(content).endswith("\n").alias("ended"))

    def hit(line: Column, i: Column) -> Column:
        if not re2.has_text_anchor(node):
            return line.rlike("(?s)" + re2.java(node))
        final = (i == F.size("lines") - 1) & ~F.col("ended")
        tests = {(a, b): line.rlike("(?s)" + re2.java(node, a, b)) for a in (True, False) for b in (True, False)}
        return F.when((i == 0) & final, tests[True, True]).when(i == 0, tests[True, False]).when(final, tests[False, True]).otherwise(tests[False, False])

    def at(i: Column) -> Column:
        return F.coalesce(F.get(F.col("lines"), i), F.lit(""))

    found = F.filter(F.transform(F.col("lines"), lambda line, i: F.struct(i.alias("i"), hit(line, i).alias("hit"))), lambda x: x["hit"])
    places = F.transform(
        found,
        lambda x: F.struct((x["i"] + 1).alias("line"), at(x["i"] - 2).alias("ctxp2"), at(x["i"] - 1).alias("ctxp1"), at(x["i"]).alias("context"), at(x["i"] + 1).alias("ctxn1"), at(x["i"] + 2).alias("ctxn2")),
    )
    return rows.select("row", F.inline(places)).select(*[f"row.`{c}`" for c in kept], "line", "ctxp2", "ctxp1", "context", "ctxn1", "ctxn2")


def with_context(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Positional hits (docid, pos) as lines with surroundings, one for each line: its first hit."""
    by_doc = hits.groupBy("docid").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    texts = files.where("content IS NOT NULL").join(by_doc, "docid").select("docid", F.col("content").cast("binary").alias("content"), F.col("places").cast("array<bigint>").alias("places"))
    found = texts.mapInArrow(_lines_of_places, f"docid {texts.schema['docid'].dataType.simpleString()}, content binary, at array<int>")
    numbered = found.select("docid", text_lines(F.col("content").cast("string")).alias("lines"), "at")
    rows = numbered.select("docid", "lines", F.explode("at").alias("line"))
    around = {"ctxp2": -3, "ctxp1": -2, "context": -1, "ctxn1": 0, "ctxn2": 1}
    return rows.select("docid", "line", *[F.coalesce(F.get("lines", F.col("line") + k), F.lit("")).alias(name) for name, k in around.items()])


def show_file(files: DataFrame, path: str) -> DataFrame:
    """(line, text) of one file; a path that leaves its package's folder is refused."""
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"not a path of the corpus: {path!r}")
    return files.where(F.col("path") == path).select(F.posexplode(text_lines(F.col("content"))).alias("i", "text")).select((F.col("i") + 1).alias("line"), "text")
