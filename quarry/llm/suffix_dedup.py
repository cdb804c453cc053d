"""Suffix-array dedup by distributed prefix doubling (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .storage import Table

#: Words that a repeat has at least.
THRESHOLD = 50
#: Words of the first names; doubled, by sorting, until the threshold.
SEED_WORDS = 13
#: Positions that a task sorts at a time.
ROWS_PER_RANGE = 200_000

_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64((1 << 64) - 1)


class _Grams:
    """Hashes of all runs of n words of a block of texts."""

    def __init__(self, texts: pa.Array):
        data, bounds = tb.flat(texts)
        starts, ends = tb.words(data, bounds)
        self.count = len(starts)
        self.first = np.searchsorted(starts, bounds)
        up, self.down = np.full(self.count + 1, _BASE, dtype=np.uint64), np.full(self.count + 1, _INVERSE, dtype=np.uint64)
        up[0] = self.down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(self.down)
        self.sums = np.zeros(self.count + 1, dtype=np.uint64)
        np.cumsum(tb.hash_spans(data, starts, ends) * up[:-1], out=self.sums[1:])

    def names(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, below 2^63; runs that would leave the block are left out."""
        if self.count < n:
            return np.zeros(0, dtype=np.uint64)
        return tb.mix((self.sums[n:] - self.sums[:-n]) * self.down[: self.count - n + 1]) >> np.uint64(1)

    def fits(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one text."""
        owner_end = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(self.count) + n <= owner_end


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best() of each window of ``width`` values, in a logarithmic number of passes."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(grams: _Grams, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and names of the anchors: of the runs of half the threshold, the least in any window of threshold words.

    Equal windows have equal anchors, so a repeat of the threshold's length has an
    anchor whose name occurs twice; whatever lies at no such anchor repeats nowhere.
    """
    half = max(1, threshold // 2)
    width = threshold - half + 1
    names = grams.names(half)
    if len(names) < width:
        return np.zeros(0, dtype=np.int64), names[:0]
    inside = grams.fits(half)[: len(names)]
    names = np.where(inside, names, _NONE)
    least = _sliding(names, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    chosen = (_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == names) & inside
    at = np.flatnonzero(chosen)
    return at, names[at]


def _anchor_rows(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                grams = _Grams(block.column("text"))
                at, names = anchors(grams, threshold)
                row = np.searchsorted(grams.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([block.column("text_hash").take(pa.array(row)), pa.array((at - grams.first[row]).astype(np.int32)), pa.array(names.view(np.int64))], ["text_hash", "pos", "name"])

    return run


def _position_rows(threshold: int, seed: int):
    # a repeat lies around its anchor; the rounds look up all prefixes of the first length in it
    before, length = threshold - max(1, threshold // 2), min(2 * seed, threshold)
    after = threshold - length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                grams = _Grams(block.column("text"))
                lists = block.column("anchors")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy(zero_copy_only=False))
                marks = np.zeros(grams.count + 1, dtype=np.int64)
                np.add.at(marks, grams.first[row] + np.maximum(flat - before, 0), 1)
                np.add.at(marks, np.minimum(grams.first[row] + flat + after + 1, grams.first[row + 1]), -1)
                active = (np.cumsum(marks[:-1]) > 0) & grams.fits(length)
                at = np.flatnonzero(active)
                names = grams.names(seed).view(np.int64)
                row = np.searchsorted(grams.first, at, side="right") - 1
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").take(taken), block.column("version").take(taken), pa.array((at - grams.first[row]).astype(np.int32)), pa.array(names[at]), pa.array(names[at + min(seed, threshold - seed)])],
                    ["doc_id", "version", "pos", "r1", "r2"],
                )

    return run


def _ranked(pairs: DataFrame, bits: int, after: list[Table]) -> DataFrame:
    """Sort the pairs (r1, r2), rank them, and keep those that aren't unique: (doc_id, version, pos, rank).

    What is sorted are distinct pairs with their counts, which are combined before
    they move, so that a pair that millions of positions have is one row; the ranks are
    joined back, where a hot pair is broadcast or split. Both ranks are spread evenly
    over 0 .. 2^63, so the leading bits of r1 cut them into equal ranges without
    sampling; the rank (range, number of repeated positions before the pair in the
    range) keeps the global order and the even spread.
    """
    pairs = Table(pairs, "pairs", after).df
    counted = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("range", F.shiftright("r1", 63 - bits))
    before = F.sum("n").over(Window.partitionBy("range").orderBy("r1", "r2").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counted.select("r1", "r2", (F.shiftleft(F.col("range"), 63 - bits) + before).alias("rank"))
    return pairs.join(Table(ranks, "ranks").df, ["r1", "r2"]).select("doc_id", "version", "pos", "rank")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, seed: int = SEED_WORDS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Repeated passages of at least ``threshold`` words: (doc_id, start_word, words, first_doc_id, first_word).

    Words are what stands between white space, compared byte for byte and numbered
    from 0. A position is a repeat if the ``threshold`` words from it on also occur
    at another one; the least (doc_id, position) of such a group is its first, null
    ids last, and every other is listed, adjacent ones as one passage as long as the
    first ones are adjacent too. Repeats within a document count. A document whose
    whole text is that of another, and long enough, is listed as one passage that
    repeats the whole of the least id with that text, and not looked at further.

    Null and empty texts and those shorter than the threshold have no passage. Rows
    alike in doc_id and text are one document; rows alike in doc_id only are two,
    the one with the lesser hash first. A null id is kept as null. Extra columns are
    ignored; empty input gives no rows.

    Method. Names of ``seed`` words are doubled by sorting: ranks of (name at p, name
    at p + seed) order the prefixes of twice the length, the next round pairs ranks
    at the doubled offset, and the last offset is cut to end at the threshold. A
    position whose pair is unique is dropped, and so is one that would pair with a
    dropped one: the rounds handle less and less. Before the first round, winnowed
    anchors (a name of half the threshold's words in any window of threshold words)
    whose name occurs once rule out most positions of a corpus without losing a
    repeat; they are a tenth of the words. Text is shuffled once, to the documents'
    anchors.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text IS NOT NULL")
    kind = base.schema["doc_id"].dataType.simpleString()
    known = Table(base.select("doc_id", "text_hash", F.regexp_count("text", F.lit(r"\S+")).alias("words")).distinct(), "texts").df.where(F.col("words") >= threshold)
    reps = known.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))
    reps = Table(reps.withColumn("version", F.row_number().over(Window.partitionBy("doc_id").orderBy("text_hash"))), "texts").df
    whole = known.alias("k").join(reps.alias("r"), "text_hash").where(~F.col("k.doc_id").eqNullSafe(F.col("r.doc_id")))
    whole = whole.select("k.doc_id", F.lit(0).alias("start_word"), F.col("k.words").cast("int").alias("words"), F.col("r.doc_id").alias("first_doc_id"), F.lit(0).alias("first_word"))

    rows = base.select("text_hash", "text").mapInArrow(_anchor_rows(threshold), "text_hash bigint, pos int, name bigint")
    place = F.xxhash64("text_hash", "pos")
    again = Table(rows.groupBy("name").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("name"), "anchor-names")
    lists = rows.join(again.df, "name").groupBy("text_hash").agg(F.collect_set("pos").alias("anchors"))
    found = Table(lists.join(reps, "text_hash"), "anchors", after=[again])
    n = found.df.agg(F.sum(F.size("anchors"))).first()[0] or 0
    bits = max(0, (n * (threshold - threshold // 2) // rows_per_range).bit_length())

    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    joined = base.alias("d").join(found.df.hint("shuffle_hash").alias("c"), same).select("d.doc_id", "c.version", "d.text", "c.anchors")
    seed = min(seed, threshold)
    pairs = joined.mapInArrow(_position_rows(threshold, seed), f"doc_id {kind}, version int, pos int, r1 bigint, r2 bigint")
    length = min(2 * seed, threshold)
    now = None
    while length < threshold:
        now = Table(_ranked(pairs, bits, [now] if now else [found]), "ranks")
        offset = min(length, threshold - length)
        ahead = F.first("rank").over(Window.partitionBy("doc_id", "version").orderBy("pos").rangeBetween(offset, offset))
        pairs = now.df.select("doc_id", "version", "pos", F.col("rank").alias("r1"), ahead.alias("r2")).where("r2 IS NOT NULL")
        length += offset
    # the last round: equal pairs are repeats, and the least position among them is the first
    pairs = Table(pairs, "last-pairs", after=[now] if now else [found]).df
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "version", "pos")
    least = Table(pairs.groupBy("r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "last-firsts").df
    firsts = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "version", "pos")]
    later = pairs.join(least, ["r1", "r2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "pos", *firsts)
    # rows alike in id and text bring each position twice; a dense rank and the minima and maxima don't mind
    by = ["doc_id", "version", "first_doc_id", "first_version", "shift"]
    islands = later.withColumn("shift", F.col("pos") - F.col("first_pos")).withColumn("island", F.col("pos") - F.dense_rank().over(Window.partitionBy(*by).orderBy("pos")))
    runs = islands.groupBy(*by, "island").agg(F.min("pos").alias("start_word"), (F.max("pos") - F.min("pos") + threshold).alias("words"))
    return runs.select("doc_id", "start_word", "words", "first_doc_id", (F.col("start_word") - F.col("shift")).alias("first_word")).unionByName(whole)
