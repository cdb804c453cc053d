"""Document fingerprints from content-defined chunks (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .storage import Table

#: Bytes of a chunk: at least, normally, at most.
SIZES = (32, 128, 512)
#: Leading zero bits that end a chunk before its normal size, and after it.
BITS = (9, 5)
#: Above so many holders of a chunk, documents are compared by the patterns of such chunks and not one by one; results don't depend on it.
HOT = 64
_WINDOW = 32
#: One random 32-bit number for each byte value.
_GEAR = (tb.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + G[byte] after each byte; 32 bits remember 32 bytes, so it is a sum over a window, here doubled five times."""
    h = _GEAR[data]
    span = 1
    while span < _WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def chunks(data: np.ndarray, bounds: np.ndarray, sizes: tuple[int, int, int] = SIZES, bits: tuple[int, int] = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the chunks of all texts, in order.

    From a chunk's start, the first place at least ``sizes[0]`` on whose hash has
    ``bits[0]`` leading zeros ends it; beyond ``sizes[1]``, ``bits[1]`` zeros do, and
    ``sizes[2]`` ends it in any case. The least size covers the hash's window, so a
    cut depends on the chunk's own bytes only, and cuts realign after an insertion.
    All texts of the block advance together, a chunk at a time.
    """
    least, normal, most = sizes
    if least < _WINDOW:
        raise ValueError(f"a chunk must have {_WINDOW} bytes at least")
    h = gear(data)
    far = np.array([len(data) + most], dtype=np.int64)
    strict, loose = (np.concatenate([np.flatnonzero(h < np.uint32(1 << (32 - b))) + 1, far]) for b in bits)
    at, end = bounds[:-1][bounds[1:] > bounds[:-1]], bounds[1:][bounds[1:] > bounds[:-1]]
    starts, ends = [], []
    while len(at):
        early = strict[np.searchsorted(strict, at + least)]
        late = loose[np.searchsorted(loose, at + normal)]
        cut = np.where(early < at + normal, early, np.minimum(late, at + most))
        cut = np.minimum(cut, end)
        starts.append(at)
        ends.append(cut)
        go = cut < end
        at, end = cut[go], end[go]
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts)
    return starts[order], ends[order]


def _rows(sizes: tuple[int, int, int], bits: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                data, bounds = tb.flat(block.column("text"))
                starts, ends = chunks(data, bounds, sizes, bits)
                digest, owner = tb.hash_spans(data, starts, ends), tb.owners(starts, bounds)
                if len(starts) and (bounds[1:] == bounds[:-1]).any():  # an empty text shares its offset with the next one
                    full = np.flatnonzero(bounds[1:] > bounds[:-1])
                    owner = full[np.searchsorted(bounds[:-1][full], starts, side="right") - 1]
                order = np.lexsort((digest, owner))
                digest, owner, length = digest[order], owner[order], (ends - starts)[order]
                new = np.ones(len(digest), dtype=bool)
                new[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
                digest, owner, length = digest[new], owner[new], length[new]
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(block))))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (digest.view(np.int64), length.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_hash"), *lists], ["doc_id", "text_hash", "digests", "lengths"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, int, int] = SIZES, bits: tuple[int, int] = BITS) -> DataFrame:
    """(doc_id, text_hash, digests ARRAY<BIGINT>, lengths ARRAY<INT>): the set of a text's chunk digests, ascending as unsigned numbers, and the chunks' bytes."""
    base = docs.select(F.col(doc_id).try_cast("bigint").alias("doc_id"), F.hash(text).alias("text_hash"), F.col(text).alias("text")).where("text IS NOT NULL")
    return base.mapInArrow(_rows(sizes, bits), "doc_id bigint, text_hash int, digests array<bigint>, lengths array<int>")


def containment(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, containment) for pairs (left, right) of ids: the share, by length, of left's chunk set that right has too; null if left has no chunk."""
    a = prints.select(F.col("doc_id").alias("left"), F.col("digests").alias("a"), F.col("lengths").alias("n"))
    b = prints.select(F.col("doc_id").alias("right"), F.col("digests").alias("b"))
    both = pairs.select("left", "right").join(a, "left").join(b, "right")
    zipped = F.arrays_zip("a", "n")
    total = F.aggregate(zipped, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    shared = F.aggregate(F.filter(zipped, lambda x: F.array_contains("b", x["a"])), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return both.select("left", "right", F.when(total > 0, shared / total).alias("containment"))


def _two_least(ids: DataFrame, key: str, value: str) -> DataFrame:
    """(key, one, two): the two least values of each key, the second null if there is none."""
    one = ids.groupBy(key).agg(F.min(value).alias("one"))
    two = ids.join(one, key).where(F.col(value) > F.col("one")).groupBy(key).agg(F.min(value).alias("two"))
    return one.join(two, key, "left")


def best_holders(shared: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, best STRUCT<held, minus>) of each document: the most bytes that one other id holds, and that id, negative.

    ``shared`` has (doc STRUCT<doc_id, text_hash>, digests, lengths). Documents with
    the same shared chunks are one set, and chunks in the same sets are one weight.
    For weights in at most ``hot`` sets all pairs of sets are summed. The others
    make a pattern of each set, and patterns are compared instead: a holder that
    has a rarer weight too gets its pattern's share added to it, and one that has
    none holds just what its pattern does. So each other holder counts in full.
    """
    askers = shared.groupBy("doc").agg(F.xxhash64(F.array_sort(F.collect_list("digests"))).alias("s"), F.sum("lengths").alias("held"))
    askers = Table(askers, "askers").df
    several = F.min("s") < F.max("s")  # rows alike in id only hold together what each of them has
    ids = askers.select(F.col("doc.doc_id").alias("id"), "s").where("id IS NOT NULL").groupBy("id")
    ids = Table(ids.agg(F.when(several, F.xxhash64(F.lit("id"), "id")).otherwise(F.min("s")).alias("o")), "holders").df
    a = F.when(F.col("o").isNull(), F.xxhash64(F.lit("none"), "s")).otherwise(F.xxhash64("s", "o")).alias("a")
    askers = Table(askers.join(ids, F.col("doc.doc_id") == F.col("id"), "left").select("doc", "held", "o", a), "asking").df
    least = Table(_two_least(ids, "o", "id"), "least").df

    same = F.col("l.doc.text_hash").eqNullSafe(F.col("r.doc.text_hash")) & F.col("l.doc.doc_id").eqNullSafe(F.col("r.doc.doc_id"))
    sets = Table(shared.alias("l").join(askers.alias("r"), same).select("a", "o", "digests", "lengths").distinct(), "sets").df
    alike = sets.groupBy("digests").agg(F.bit_xor("a").alias("x"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("k"), F.first("lengths").alias("n"))
    weights = alike.groupBy("x", "y", "k").agg(F.min("digests").alias("digests"), F.sum("n").alias("w"))
    sets = Table(sets.join(weights, "digests").select("a", "o", F.col("digests").alias("g"), "w", "k"), "weights").df

    def pattern(of: str, name: str) -> DataFrame:
        return often.where(F.col(of).isNotNull()).select(of, "g").distinct().groupBy(of).agg(F.xxhash64(F.array_sort(F.collect_list("g"))).alias(name))

    often, seldom = sets.where(F.col("k") > hot), sets.where(F.col("k") <= hot)
    p, q = Table(pattern("a", "p"), "patterns").df, Table(pattern("o", "q"), "patterns").df
    asked = often.join(p, "a").select("p", "g", "w").distinct()
    held = often.join(q, "o").select("q", "g").distinct()
    overlap = Table(asked.join(held, "g").groupBy("p", "q").agg(F.sum("w").alias("both")), "overlaps").df

    holders = seldom.where("o IS NOT NULL").select(F.col("o").alias("t"), "g").distinct()
    pairs = seldom.join(holders, "g").where("o IS NULL OR o <> t").groupBy("a", "t").agg(F.sum("w").alias("part"))
    pairs = pairs.join(p, "a", "left").join(q.withColumnRenamed("o", "t"), "t", "left").join(overlap, ["p", "q"], "left").join(least.withColumnRenamed("o", "t"), "t")
    rare = pairs.groupBy("a").agg(F.max(F.struct((F.col("part") + F.coalesce("both", F.lit(0))).alias("held"), (-F.col("one")).alias("minus"))).alias("rare"))

    firsts = _two_least(q.join(least, "o").select("q", F.struct(F.col("one").alias("id"), "o").alias("v")), "q", "v")
    kinds = Table(p.join(askers.select("a", "o").distinct(), "a").join(q, "o", "left").select("a", "o", "p", F.col("q").alias("own")), "kinds").df
    others = kinds.select("p", "own").distinct().join(overlap, "p").where("own IS NULL OR own <> q").join(firsts, "q")
    others = others.groupBy("p", "own").agg(F.max(F.struct(F.col("both").alias("held"), (-F.col("one.id")).alias("minus"))).alias("others"))
    peer = F.when(F.col("one.o") != F.col("o"), F.col("one.id")).otherwise(F.col("two.id"))
    peers = kinds.join(overlap.withColumnRenamed("q", "own"), ["p", "own"]).join(firsts.withColumnRenamed("q", "own"), "own").select("a", peer.alias("peer"), "both")
    peers = peers.where("peer IS NOT NULL").select("a", F.struct(F.col("both").alias("held"), (-F.col("peer")).alias("minus")).alias("peers"))
    k, r = kinds.alias("k"), others.alias("r")
    others = k.join(r, (F.col("k.p") == F.col("r.p")) & F.col("k.own").eqNullSafe(F.col("r.own"))).select("k.a", "r.others")

    copy = F.when(F.col("one") != F.col("doc.doc_id"), F.col("one")).otherwise(F.col("two"))
    found = askers.join(least, "o", "left").join(rare, "a", "left").join(others, "a", "left").join(peers, "a", "left")
    copies = F.when(copy.isNotNull(), F.struct(F.col("held"), (-copy).alias("minus")))
    return found.select("doc", F.greatest(copies, "rare", "others", "peers").alias("best"))


def corpus_containment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, int, int] = SIZES, bits: tuple[int, int] = BITS) -> DataFrame:
    """Fingerprint every document and measure how much of it the rest of the corpus contains.

    Returns (doc_id, digests, lengths, bytes, shared_bytes, containment,
    container_id, container_bytes). ``bytes`` is the length of the chunk set,
    ``shared_bytes`` that of its chunks which another document has too, and
    ``containment`` their quotient. ``container_id`` is the other document that holds
    most of this one's bytes (ties: the least id), sought among all holders of all its
    chunks, and ``container_bytes`` how many; both are null if none holds any.

    A null text has no row; an empty one has no chunks, 0 bytes and a null
    containment. Rows alike in id and text are one document and give one row; rows
    alike in id only are counted as one holder but give a row each. A row without an
    id, or with one that isn't a whole number, shares with others but holds nothing, so it
    is no container. Texts of any length are cut whole; extra columns of any name are
    ignored; empty input gives no rows.

    Every chunk crosses the network once, by digest, as 64 hash bits, its document
    and its length; what comes back to the documents are only the shared ones. Pairs
    are formed of sets of chunks, not of documents (:func:`best_holders`), so copies
    by the thousand cost what they weigh.
    """
    prints = Table(fingerprints(docs, doc_id, text, sizes, bits).dropDuplicates(["doc_id", "text_hash"]), "chunks").df
    rows = prints.select("doc_id", "text_hash", F.inline(F.arrays_zip("digests", "lengths")))
    held = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("doc_id").alias("named"), F.count(F.lit(1)).alias("n")]
    kinds = rows.groupBy("digests").agg(*held).where("n > 1 AND NOT coalesce(least = most AND named = n, false)").select("digests")
    kinds = Table(kinds, "chunk-kinds")
    shared = Table(rows.join(kinds.df, "digests").select(F.struct("doc_id", "text_hash").alias("doc"), "digests", "lengths"), "shared", after=[kinds]).df
    found = best_holders(shared, HOT).alias("f")
    sums = shared.groupBy("doc").agg(F.sum("lengths").alias("shared_bytes")).alias("t")
    same_doc = F.col("t.doc.doc_id").eqNullSafe(F.col("f.doc.doc_id")) & (F.col("t.doc.text_hash") == F.col("f.doc.text_hash"))
    per_doc = sums.join(found, same_doc).select("t.doc", "shared_bytes", "best")
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)
    joined = prints.alias("p").join(per_doc.alias("s"), F.col("p.doc_id").eqNullSafe(F.col("s.doc.doc_id")) & (F.col("p.text_hash") == F.col("s.doc.text_hash")), "left")
    out = joined.select("p.doc_id", "p.digests", "p.lengths", total.alias("bytes"), F.coalesce("s.shared_bytes", F.lit(0).cast("bigint")).alias("shared_bytes"), "s.best")
    return out.select("doc_id", "digests", "lengths", "bytes", "shared_bytes", F.when(F.col("bytes") > 0, F.col("shared_bytes") / F.col("bytes")).alias("containment"), (-F.col("best.minus")).alias("container_id"), F.col("best.held").alias("container_bytes"))
