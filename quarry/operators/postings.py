"""The trigram index: extraction, postings, lookup, and putting indexes together."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.trigrams import Query, trigram_code

#: Three blanks, whose positions no index keeps.
BLANKS = 0x202020
#: Docids in a block of a decoded list.
BLOCK = 1 << 20
_BLOCK = 1 << 20
#: Bytes of text in a sorted run of a written index, and its postings in a batch.
RUN, _SENT = 8 << 20, 1 << 16


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the places between which each lies."""
    if pa.types.is_large_binary(texts.type) or pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    else:
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, dtype=np.uint8)
    return raw, bounds - bounds[0]


def _rows(ids: pa.Array, texts: pa.Array, positions: bool, wanted: np.ndarray | None) -> pa.RecordBatch:
    raw, bounds = _bytes(texts)
    raw = raw.astype(np.uint64)
    n = max(0, len(raw) - 2)
    code = (raw[:n] << np.uint64(16) | raw[1 : n + 1] << np.uint64(8) | raw[2:]) if n else raw[:0]
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[:n]
    at = np.arange(n)
    inside = at + 3 <= bounds[1:][owner] if n else np.zeros(0, dtype=bool)
    if wanted is not None:
        inside &= wanted[code.astype(np.int64)]
    key = (owner[inside].astype(np.uint64) << np.uint64(24)) | code[inside]
    place = at[inside] - bounds[owner[inside]]
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    lists = np.append(first, len(key)).astype(np.int32)
    columns = [pa.array((key[first] & np.uint64(0xFFFFFF)).astype(np.int32)), ids.take(pa.array((key[first] >> np.uint64(24)).astype(np.int64))), pa.array(np.diff(lists))]
    names = ["trigram", "docid", "n"]
    if positions:
        columns.append(pa.ListArray.from_arrays(pa.array(lists), pa.array(place.astype(np.int32))))
        names.append("positions")
    return pa.RecordBatch.from_arrays(columns, names)


def postings(files: DataFrame, docid: str = "docid", content: str = "content", positions: bool = True, wanted: Iterable[bytes] | None = None) -> DataFrame:
    """(trigram INT, docid, n INT, positions ARRAY<INT>): a row for each byte trigram of each file, with the bytes at which it begins.

    Nothing is shuffled; files without three bytes have no rows, rows without an id or a content are left out.
    With ``wanted`` only these trigrams are taken, before anything is sorted: what a query needs of files that have no index.
    """
    codes = None if wanted is None else [trigram_code(t) for t in wanted]
    rows = files.select(F.col(docid).alias("docid"), F.col(content).alias("content")).where("docid IS NOT NULL AND content IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = None
        if codes is not None:
            chosen = np.zeros(1 << 24, dtype=bool)
            chosen[codes] = True
        for batch in batches:
            ids, texts = batch.column("docid"), batch.column("content")
            size = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0)
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + _BLOCK, side="right")))
                yield _rows(ids.slice(start, end - start), texts.slice(start, end - start), positions, chosen)
                start = end

    kind = rows.schema["docid"].dataType.simpleString()
    return rows.mapInArrow(run, f"trigram int, docid {kind}, n int" + ", positions array<int>" * positions)


def _run(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The postings of some texts by trigram, then in the texts' order: one sort of numbers, a trigram above the place where it begins."""
    raw, bounds = _bytes(texts)
    n = max(0, len(raw) - 2)
    ends = np.concatenate((bounds[1:] - 1, bounds[1:] - 2))
    inside = np.ones(n, dtype=bool)
    inside[ends[(ends >= 0) & (ends < n)]] = False
    at = np.flatnonzero(inside).astype(np.uint64)
    raw = raw.astype(np.uint32)
    key = (raw[:n] << np.uint32(16) | raw[1 : n + 1] << np.uint32(8) | raw[2:])[inside].astype(np.uint64) << np.uint64(32) | at if n else at
    key.sort()
    at, code = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))[at]
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))) if len(at) else np.zeros(0, dtype=np.int64)
    lists = np.append(first, len(at)).astype(np.int32)
    place = (at - bounds[owner]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(code[first]), ids.take(pa.array(owner[first])), pa.array(np.diff(lists)), pa.ListArray.from_arrays(pa.array(lists), pa.array(place))], ["trigram", "docid", "n", "positions"])


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(docids, texts) of up to ``most`` bytes of text, or one text that is longer, whatever the batches' bounds."""
    held, room = [], most
    for batch in batches:
        ids, texts = batch.column("docid"), batch.column("content")
        texts = texts.cast(pa.large_binary() if pa.types.is_large_binary(texts.type) or pa.types.is_binary(texts.type) else pa.large_string())
        size, start = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < len(texts):
            before = size[start - 1] if start else 0
            end = max(int(np.searchsorted(size, before + room, side="right")), start + (not held))
            if end > start:
                held.append((ids.slice(start, end - start), texts.slice(start, end - start)))
                room -= size[end - 1] - before
            if end < len(texts):
                yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))
                held, room = [], most
            start = end
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held, strict=True)))


def runs(files: DataFrame, most: int = RUN) -> DataFrame:
    """The postings of :func:`postings` with positions, each task's in runs of ``most`` bytes of text that are sorted by trigram. Nothing is shuffled."""
    rows = files.select("docid", "content").where("docid IS NOT NULL AND content IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _gathered(batches, most):
            postings = _run(ids, texts)
            yield from (postings.slice(i, _SENT) for i in range(0, postings.num_rows, _SENT))

    return rows.mapInArrow(run, f"trigram int, docid {rows.schema['docid'].dataType.simpleString()}, n int, positions array<int>")


#: An index: a table of postings, or what makes one of the trigrams that are asked for.
Index = DataFrame | Callable[[list[bytes]], DataFrame]


def write_index(files: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Write postings as Parquet; see :mod:`store` for publishing.

    Each task writes those of its own files, in sorted runs: postings are several times as large as their texts, so
    they aren't moved. A lookup skips all but a page or two of each run by the pages' bounds. With
    ``partitions``, they are ranged and sorted as a whole, by trigram and docid, over so many files.
    """
    if partitions:
        keys = ("trigram", "docid")  # a trigram that most files have fills several ranges
        postings(files).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.parquet(folder)
    else:
        runs(files).write.parquet(folder)


def listed(index: Index, trigrams: list[bytes]) -> DataFrame:
    """The postings of some trigrams: pushed down to a written index, or extracted alone."""
    rows = index if isinstance(index, DataFrame) else index(trigrams)
    return rows.where(F.col("trigram").isin(*map(trigram_code, trigrams)))


def distinct_trigrams(files: DataFrame) -> DataFrame:
    """(docid, n_trigrams), exact; 0 for files too short to have one."""
    counts = postings(files, positions=False).groupBy("docid").agg(F.count(F.lit(1)).alias("n_trigrams"))
    return files.select("docid").join(counts, "docid", "left").select("docid", F.coalesce("n_trigrams", F.lit(0)).alias("n_trigrams"))


def trigram_meta(index: DataFrame) -> DataFrame:
    """(trigram, n_docs, n_pos): entries of each posting list."""
    return index.groupBy("trigram").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_pos"))


def sources_of(index: DataFrame) -> DataFrame:
    """(trigram, sources) from (trigram, source): which indexes have a trigram at all, in order, so that a merge reads no others."""
    return index.groupBy("trigram").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def posting_list(index: DataFrame, trigram: bytes) -> DataFrame:
    """(docid), ascending."""
    return index.where(F.col("trigram") == trigram_code(trigram)).select("docid").orderBy("docid")


def posting_deltas(index: DataFrame, trigram: bytes) -> DataFrame:
    """(docid, delta): each docid less the one before it."""
    before = F.lag("docid").over(Window.partitionBy("trigram").orderBy("docid"))
    listed = index.where(F.col("trigram") == trigram_code(trigram))
    return listed.select("docid", (F.col("docid") - F.coalesce(before, F.lit(0))).alias("delta"))


def decode_deltas(deltas: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """Running sums of ``delta``: the docids again. ``order`` is a whole number.

    One list without ``by`` is cut into blocks of ``order``: their sums give each block's offset, and only these few are summed in one place.
    """
    if by:
        return deltas.withColumn("docid", F.sum("delta").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    block = (F.col(order) / BLOCK).cast("bigint")
    sums = deltas.groupBy(block.alias("block")).agg(F.sum("delta").alias("sum"))
    offsets = sums.select("block", (F.sum("sum").over(Window.partitionBy().orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("offset"))
    local = F.sum("delta").over(Window.partitionBy("block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return deltas.withColumn("block", block).join(offsets, "block").select(*deltas.columns, (local + F.col("offset")).alias("docid"))


def positions_of(index: DataFrame, trigram: bytes) -> DataFrame:
    """(docid, pos, new_doc): all places of a trigram, and whether the document changes with it."""
    if trigram_code(trigram) == BLANKS:
        index = index.where(F.lit(False))
    rows = index.where(F.col("trigram") == trigram_code(trigram)).select("docid", F.posexplode("positions").alias("k", "pos"))
    return rows.select("docid", "pos", (F.col("k") == 0).alias("new_doc"))


def lookup(files: DataFrame, docids: DataFrame) -> DataFrame:
    """(docid, path) of the given docids."""
    return docids.select("docid").join(files.select("docid", "path"), "docid")


def condition(query: Query, has) -> Column:
    """The query as a Column; ``has(trigram)`` says whether the document has it."""
    if query.op in ("all", "none"):
        return F.lit(query.op == "all")
    parts = [has(t) for t in query.trigrams] + [condition(s, has) for s in query.subs]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query.op == "and" else out | p
    return out


def candidates(index: Index, query: Query, files: DataFrame) -> DataFrame:
    """(docid) of the documents that meet a trigram query.

    The lists of all its trigrams are read in one scan and meet in one shuffle of
    docids, whatever the query's nesting; each document is a set of flags by then.
    """
    if not query.usable:
        return files.select("docid").where(F.lit(query.op == "all"))
    leaves = sorted(query.leaves())
    rows = listed(index, leaves).select("docid", "trigram")
    if len(leaves) == 1:
        return rows.select("docid").distinct()
    flags = [F.max(F.col("trigram") == trigram_code(t)).alias(f"t{i}") for i, t in enumerate(leaves)]
    seen = rows.groupBy("docid").agg(*flags)
    return seen.where(condition(query, lambda t: F.col(f"t{leaves.index(t)}"))).select("docid")


def phrase_positions(index: Index, literal: bytes) -> DataFrame:
    """(docid, pos) at which the literal's first trigram stands with its last one as far behind it as in the literal; to be verified if it is longer than six bytes.

    Both lists come from one scan and meet in one shuffle, as arrays of a document.
    """
    if len(literal) < 3:
        raise ValueError("a literal of fewer than three bytes has no trigram")
    first, last, shift = trigram_code(literal[:3]), trigram_code(literal[-3:]), len(literal) - 3
    rows = listed(index, [literal[:3], literal[-3:]])
    if not shift:
        return rows.select("docid", F.explode("positions").alias("pos"))
    if first == last:
        both = rows.select("docid", F.col("positions").alias("a"), F.col("positions").alias("b"))
    else:
        side = lambda code, name: F.max(F.when(F.col("trigram") == code, F.col("positions"))).alias(name)
        both = rows.groupBy("docid").agg(side(first, "a"), side(last, "b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("docid", F.explode(F.array_intersect("a", F.transform("b", lambda p: p - shift))).alias("pos"))


def verified(places: DataFrame, files: DataFrame, literal: bytes) -> DataFrame:
    """The (docid, pos) of ``places`` at which the literal really stands, compared as bytes."""
    by_doc = places.groupBy("docid").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    texts = files.select("docid", F.col("content").cast("binary").alias("content")).join(by_doc, "docid")
    rows = texts.select("docid", "content", F.explode("places").alias("pos"))
    return rows.where(F.substring(F.col("content"), F.col("pos") + 1, F.lit(len(literal))) == F.lit(literal)).select("docid", "pos")


def docid_bases(sources: DataFrame) -> DataFrame:
    """(source, base) from (source, n_docs): how many docids precede each source in the concatenated index. One row a source."""
    before = Window.partitionBy().orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    return sources.select("source", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("base"))


def concatenate(index: DataFrame, sources: DataFrame) -> DataFrame:
    """Postings (source, trigram, docid, ...) of disjoint indexes as those of one, docids rebased by source."""
    bases = docid_bases(sources)
    others = [c for c in index.columns if c not in ("source", "docid")]
    return index.join(bases, "source").select((F.col("docid") + F.col("base")).alias("docid"), *others)


def override(older: DataFrame, newer: DataFrame, roots: DataFrame) -> DataFrame:
    """Files of two indexes; below a root of the newer one only its own. ``roots`` has (root), whole path prefixes.

    A path is joined by its prefixes of those lengths that roots have, which are few: their number is read first.
    """
    roots = roots.select("root").where("root IS NOT NULL").distinct()
    lengths = [r.n for r in roots.select(F.length("root").alias("n")).distinct().collect()]
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.when(n <= F.length("path"), F.substr("path", F.lit(1), n))), lambda p: p.isNotNull())
    taken = older.select("path", F.explode(prefixes).alias("root")).join(roots, "root").select("path").distinct()
    return older.join(taken, "path", "left_anti").unionByName(newer)
