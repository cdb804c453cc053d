"""Substring dedup over sliding sentence spans (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .storage import Table

#: A span is the shortest run of consecutive sentences with at least so many sentences and words; half of the 50 words
#: from which a repeated passage counts, so that one holds whole spans although its ends are glued to other text.
SENTENCES, WORDS = 2, 25

#: A sentence, or a clause of one, ends after one of these marks before white space, and at a line end.
_MARKS = ".!?,;:"
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*b" \t\n\r"]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*_MARKS.encode()]] = True
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words, first): bytes of the sentences without the white space around them, their numbers of words, and each text's first sentence."""
    starts, ends = tb.words(data, bounds, _WHITE)
    if not len(starts):
        return starts, ends, starts, np.zeros(len(bounds), dtype=np.int64)
    first = np.searchsorted(starts, bounds)
    final = np.zeros(len(starts), dtype=bool)
    final[first[1:][first[1:] > first[:-1]] - 1] = True
    newlines = np.concatenate(([0], np.cumsum(data == 10)))
    after = np.append(starts[1:], len(data))
    close = final | _ENDS[data[ends - 1]] | (newlines[after] > newlines[ends])
    last = np.flatnonzero(close)
    head = np.concatenate(([0], last[:-1] + 1))
    return starts[head], ends[last], last - head + 1, np.searchsorted(starts[head], bounds)


def spans(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, least: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, hash) of all spans, ``to`` exclusive: one from each sentence on that has enough after it, and the whole of a text too short for any."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(words)))
    owner_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    to = np.maximum(at + least, np.searchsorted(total, total[:-1] + least_words))
    head = np.zeros(n, dtype=bool)
    head[first[:-1][first[1:] > first[:-1]]] = True
    to = np.where(head, np.minimum(to, owner_end), to)
    at = at[to <= owner_end]
    to = to[at]
    up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 1, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * np.cumprod(up)[:-1], out=sums[1:])
    return at, to, (sums[to] - sums[at]) * np.cumprod(down)[at] + (to - at).astype(np.uint64)


def _span_rows(sentences: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                data, bounds = tb.flat(block.column("text"))
                starts, ends, sizes, first = pieces(data, bounds)
                if not len(starts):
                    continue
                at, to, h = spans(tb.hash_spans(data, starts, ends), sizes, first, sentences, words)
                row = np.searchsorted(first, at, side="right") - 1
                before = np.where(at == first[row], bounds[row], ends[np.maximum(at - 1, 0)])
                taken = pa.array(row)
                columns = [block.column("doc_id").take(taken), block.column("text_hash").take(taken)]
                columns += [pa.array(x.astype(np.int32)) for x in (at - first[row], to - first[row] - 1, before - bounds[row], ends[to - 1] - bounds[row])]
                columns += [pa.array(tb.mix(h).view(np.int64)), pa.array((tb.mix(h ^ _SECOND) >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "pos", "last", "b0", "b1", "h", "g"])

    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Sentences to remove: (doc_id, text_hash, n, cuts ARRAY<STRUCT<b0, b1>>), their number and the disjoint, ascending byte ranges they fill.

    The spans' hashes are counted with map-side combining, and only those that occur
    again are looked for among the spans; so a span that a third of all documents hold
    is one row of counts, and a skewed join that is broadcast or split. The first
    of each kind is again a minimum joined back. Text doesn't move until the last join.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = base.schema["doc_id"].dataType.simpleString()
    found = base.mapInArrow(_span_rows(sentences, words), f"doc_id {kind}, text_hash bigint, pos int, last int, b0 int, b1 int, h bigint, g int")
    again = Table(found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g"), "span-kinds")
    repeats = Table(found.join(again.df, ["h", "g"]), "span-repeats", after=[again]).df
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash", "pos")
    least = Table(repeats.groupBy("h", "g").agg(F.min(place).alias("least")), "span-firsts").df
    later = repeats.join(least, ["h", "g"]).where(~place.eqNullSafe(F.col("least"))).select("doc_id", "text_hash", "pos", "last", "b0", "b1").distinct()
    of = Window.partitionBy("doc_id", "text_hash").orderBy("pos")
    reach = F.max("last").over(of.rowsBetween(Window.unboundedPreceding, -1))
    fresh = later.withColumn("fresh", F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(of)).groupBy("doc_id", "text_hash", "run")
    runs = runs.agg(F.min("b0").alias("b0"), F.max("b1").alias("b1"), (F.max("last") - F.min("pos") + 1).alias("n"))
    return runs.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("b0", "b1"))).alias("cuts"))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Remove the sentences that any non-first repeated span covers.

    A sentence (or clause) ends after one of . ! ? , ; : before white space, or at a
    line end. A span is the shortest run of at least ``sentences`` consecutive ones
    with at least ``words`` words, from each sentence on; a text without such a run is
    one span as a whole, however short. Spans are compared sentence by sentence, without the white space between.
    The first span of a kind is the one with the least (doc_id, hash of the text,
    position), null ids last; within one document the later of two repeats goes
    too. Rows alike in doc_id and text are one document and get the same result;
    rows alike in doc_id only are two.

    Returns the columns of ``docs`` with the text replaced, and
    ``removed_sentences`` (BIGINT), which replaces an input column of that name.
    A null text stays null, an empty one and one of white space stay as they are,
    with 0 removed; a text that repeats wholly becomes what white space is left,
    often the empty string. Texts without repeats come back unchanged. Any type of
    id does, any length of text, and columns of any name. Empty input gives empty output.
    """
    runs = Table(repeated_spans(docs, doc_id, text, sentences, words), "span-cuts").df.select(F.struct("*").alias("rep"))
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("rep.doc_id")) & (F.xxhash64(f"row.`{text}`") == F.col("rep.text_hash"))
    joined = rows.join(runs, same, "left")
    raw, cuts = F.col(f"row.`{text}`").cast("binary"), F.col("rep.cuts")
    # what is kept lies before the first cut, between two, and after the last
    from_ = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["b1"]))
    to = F.concat(F.transform(cuts, lambda c: c["b0"]), F.array(F.octet_length(raw)))
    kept = F.transform(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda s: F.substring(raw, s["a"] + 1, s["b"] - s["a"]).cast("string"))
    others = [c for c in docs.columns if c != "removed_sentences"]
    return joined.select(
        *[(F.when(F.col("rep").isNull(), F.col(f"row.`{c}`")).otherwise(F.array_join(kept, "")) if c == text else F.col(f"row.`{c}`")).alias(c) for c in others],
        F.coalesce(F.col("rep.n"), F.lit(0)).cast("bigint").alias("removed_sentences"),
    )


_BORDER = rf"([{_MARKS}])([ \t\n\r])|([^ \t\n\r])([ \t\r]*\n|[ \t\r]+$)"
#: The same in DuckDB, over ``documents`` (whose ids are unique).
SQL = rf"""
WITH pieces AS (
  SELECT doc_id, string_split(regexp_replace(text, '{_BORDER}', '\1\3' || chr(1) || '\2\4', 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i, p[i] AS piece, trim(p[i], ' ' || chr(9) || chr(10) || chr(13)) AS bare FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces)),
counted AS (SELECT *, sum(len(regexp_extract_all(bare, '[^ \t\n\r]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM s WHERE bare <> ''),
bares AS (SELECT doc_id, list(bare ORDER BY i) AS b, list(upto ORDER BY i) AS w, count(*) AS m FROM counted GROUP BY doc_id),
starts AS (SELECT doc_id, b, w, m, unnest(range(1, m + 1)) AS a FROM bares),
reach AS (SELECT doc_id, b, m, a, greatest(a + {SENTENCES - 1}, len(list_filter(w[a:a + {WORDS}], lambda x: x < coalesce(w[a - 1], 0) + {WORDS})) + a) AS z FROM starts),
spans AS (
  SELECT doc_id, a, least(z, m) AS z, array_to_string(b[a:least(z, m)], chr(1)) AS span FROM reach WHERE z <= m OR a = 1),
later AS (SELECT doc_id, a, z FROM spans QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, a) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM later),
kept AS (
  SELECT s.doc_id, coalesce(string_agg(piece, '' ORDER BY s.i) FILTER (WHERE c.i IS NULL), '') AS text, count(c.i) AS removed_sentences
  FROM s LEFT JOIN covered c ON c.doc_id = s.doc_id AND c.i = s.i GROUP BY s.doc_id)
SELECT doc_id, CASE WHEN coalesce(removed_sentences, 0) = 0 THEN documents.text ELSE kept.text END AS text, coalesce(removed_sentences, 0) AS removed_sentences
FROM documents LEFT JOIN kept USING (doc_id)
"""
