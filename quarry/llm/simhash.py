"""SimHash near-dedup with vantage-point trees (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .groups import components_table, members
from .storage import Table

#: Near duplicates differ in at most so many of 128 bits.
RADIUS = 24
#: Fingerprints in a shard, at least; a task compares a shard with others.
SHARD_ROWS = 8192
#: Shards grow with the table, up to so many fingerprints, while there are this many of them or fewer: each goes to half of the others.
MOST_SHARD_ROWS, FEW_SHARDS = 524_288, 12
#: Fingerprints that a shard is compared with in one task, about; the more there are, the less a pair costs.
MOST_POINTS = 1_000_000
#: The tree of shards is laid out by so many fingerprints, those with the least hashes; every fingerprint is placed by it.
SAMPLE_ROWS = 16_384
LEAF = 1024
_ASKED = 256
#: Queries that the search by words takes at a time where a row of a bucket holds 8 points (fewer where it holds more), so that what it makes stays in the cache.
_CHUNK = 32_768
#: Points in a row of their buckets, at most, and the share of buckets that may be longer than a row.
_WIDEST, _LONG = 64, 0.3
#: Nanoseconds, measured with buckets in groups of four and not again since: a pair compared outright; a changed word tried; a bucket looked up; a pair in a bucket; a pair that its quarter lets through.
_COMPARE, _TRY, _LOOK_UP, _CANDIDATE, _CHECK = 7.5, 200_000, 30, 4, 60

_APART = np.ones(256, dtype=bool)
_APART[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = False
_APART[128:] = False
_SECOND = np.uint64(0xD1B54A32D192ED03)
_LANE = np.uint64(0x0101010101010101)
#: Words whose byte-wide counters can be added without overflow, at a weight of 4 at most.
_RUN = 63


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints and the levels of the texts: 0, or -9 for one without a word.

    Every distinct lower-case word votes with its hash bits; longer words, which
    say more, with up to four votes. A text without a word gets the hash of its
    bytes and the level -9, so that only equal texts of that kind are near.
    """
    n = len(texts)
    data, bounds = tb.flat(pc.utf8_lower(texts))
    starts, ends = tb.words(data, bounds, _APART)
    out, level = np.zeros((n, 2), dtype=np.uint64), np.full(n, -9, dtype=np.int32)
    owner = tb.owners(starts, bounds)
    counts = np.bincount(owner, minlength=n)
    some = counts > 0
    level[some] = 0
    if not some.all():
        raw, ends_of = tb.flat(texts)
        bare = np.flatnonzero(~some)
        out[bare, 0] = tb.hash_spans(raw, ends_of[:-1][bare], ends_of[1:][bare])
        out[bare, 1] = tb.mix(out[bare, 0] ^ _SECOND)
    if not some.any():
        return out, level
    weight = np.clip(ends - starts - 2, 1, 4).astype(np.uint64)
    key = (owner.astype(np.uint64) << np.uint64(51)) | ((tb.hash_spans(data, starts, ends) >> np.uint64(15)) << np.uint64(2)) | (weight - np.uint64(1))
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    owner = (key >> np.uint64(51)).astype(np.int64)
    weight = (key & np.uint64(3)) + np.uint64(1)
    feature = tb.mix((key >> np.uint64(2)) & np.uint64((1 << 49) - 1))
    present, first = np.unique(owner, return_index=True)
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    runs = np.flatnonzero(place % _RUN == 0)
    texts_of_runs = np.searchsorted(runs, first)
    total = np.add.reduceat(weight, first).astype(np.int64)
    for half in (0, 1):
        x = tb.mix(feature ^ _SECOND) if half else feature
        sums = np.empty((len(runs), 8, 8), dtype=np.uint8)
        for k in range(8):
            lane = ((x >> np.uint64(k)) & _LANE) * weight
            sums[:, :, k] = np.add.reduceat(lane, runs).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(sums.reshape(-1, 64), texts_of_runs, axis=0, dtype=np.int64)
        bits = np.packbits(2 * votes > total[:, None], axis=1, bitorder="little")
        out[present, half] = bits.view(np.uint64)[:, 0]
    return out, level


class VantagePointTree:
    """Exact range search among 128-bit fingerprints.

    A node keeps a vantage point and, for each half of its points, the interval of
    their distances to it. With q at distance d from the vantage point, the triangle
    inequality lets a half be skipped unless its interval meets [d - r, d + r]. Where
    that excludes little since the points are far from one another, :func:`_by_words` searches all of a
    node's points at once; where they are close together, their leaves are compared outright.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes = points, []
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        here = len(self.nodes)
        self.nodes.append(None)
        if len(rows) > leaf:
            far = distances(self.points[rows], self.points[rows[0]])
            middle = np.median(far)
            near = far <= middle if (far <= middle).sum() < len(rows) else far < middle
            if 0 < near.sum() < len(rows):
                children = [(int(far[half].min()), int(far[half].max()), self._build(rows[half], leaf)) for half in (near, ~near)]
                self.nodes[here] = (rows, children)
                return here
        self.nodes[here] = (rows, [])
        return here

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, point row, distance) of all that lie within the radius, in pieces."""
        stack = [(self.root, np.arange(len(queries)))]
        most = max(len(rows) for rows, children in self.nodes if not children)
        xor, count = np.empty((_ASKED, most), dtype=np.uint64), np.empty((_ASKED, most), dtype=np.uint8)
        while stack:
            at, asked = stack.pop()
            node, children = self.nodes[at]
            if _words_pay(queries, asked, self.points, node, radius):
                for q, p, d in _by_words(queries[asked], self.points[node], radius):
                    yield asked[q], node[p], d
                continue
            if children:
                d = distances(queries[asked], self.points[node[0]])
                for low, high, child in children:
                    go = asked[(d - radius <= high) & (d + radius >= low)]
                    if len(go):
                        stack.append((child, go))
                continue
            a, b = np.ascontiguousarray(self.points[node, 0]), self.points[node, 1]
            for i in range(0, len(asked), _ASKED):
                some = asked[i : i + _ASKED]
                bits, half = xor[: len(some), : len(node)], count[: len(some), : len(node)]
                np.bitwise_xor(queries[some, 0][:, None], a, out=bits)
                np.bitwise_count(bits, out=half)
                q, p = np.divmod(np.flatnonzero(half <= radius), len(node))
                d = half[q, p] + np.bitwise_count(queries[some[q], 1] ^ b[p])
                hit = d <= radius
                if hit.any():
                    yield some[q[hit]], node[p[hit]], d[hit].astype(np.int32)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ to).sum(axis=-1, dtype=np.int32)


@lru_cache(maxsize=8)
def _word_limits(radius: int) -> list[tuple[int, int, int]]:
    """(word, its limit, its quarter's limit): any two fingerprints within the radius have a 16-bit word in which both hold.

    Distances of the four quarters add up to that of the whole, so not all of them can exceed
    limits that add up to the radius less 3; and likewise with the two words of a quarter.
    """
    limits = []
    for quarter in range(4):
        most = (radius - 3 + quarter) // 4
        limits += [(2 * quarter + half, (most - 1 + half) // 2, most) for half in (0, 1)]
    return [x for x in limits if x[1] >= 0]


@lru_cache(maxsize=17)
def _masks(most: int) -> np.ndarray:
    """The 16-bit words of at most so many bits."""
    return np.flatnonzero(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)) <= most)


def _word_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the eight words, and of the quarter that each is in."""
    words = np.bitwise_count((a ^ b).view(np.uint16))
    quarters = words[..., 0::2] + words[..., 1::2]
    return words, np.repeat(quarters, 2, axis=-1)


def _words_pay(queries: np.ndarray, asked: np.ndarray, points: np.ndarray, rows: np.ndarray, radius: int) -> bool:
    """Whether a search by words is cheaper than to compare all pairs, going by a sample of them; both find the same."""
    limits = _word_limits(radius)
    looks = sum(len(_masks(most)) for _, most, _ in limits)
    tries = looks * (_TRY / max(1, len(asked)) + _LOOK_UP) / max(1, len(rows))
    if tries >= _COMPARE:
        return False
    some, of = asked[:: -(-len(asked) // 64)], rows[:: -(-len(rows) // 2048)]
    words, quarters = _word_distances(queries[some][:, None], points[of])
    pairs = len(some) * len(of)
    alike = [(words[..., w] <= most, quarters[..., w] <= quarter) for w, most, quarter in limits]
    candidates = sum(a.sum() for a, _ in alike) / pairs
    checks = sum((a & b).sum() for a, b in alike) / pairs
    return tries + candidates * _CANDIDATE + checks * _CHECK < _COMPARE


class _Buckets:
    """Points by one of their words, as rows of the other words of their quarters; a bucket's first row lies at its word, any further ones beyond the last word."""

    def __init__(self, points: np.ndarray, word: int, asked: np.ndarray):
        words = points.view(np.uint16)
        key = words[:, word]
        order = np.argsort(key, kind="stable")
        size = np.bincount(key, minlength=1 << 16)
        self.width = 4
        while self.width < _WIDEST and (size[asked] > self.width).mean() > _LONG:
            self.width *= 2
        self.more = np.maximum(-(-size // self.width) - 1, 0)
        self.any_more = self.more > 0
        self.first = (1 << 16) + np.cumsum(self.more) - self.more
        at = key[order].astype(np.int64)
        layer, place = np.divmod(np.arange(len(order)) - (np.cumsum(size) - size)[at], self.width)
        slot = np.where(layer == 0, at, self.first[at] + layer - 1) * self.width + place
        n = self.width * ((1 << 16) + int(self.more.sum()))
        self.rows, mates = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.uint16)
        self.rows[slot], mates[slot] = order, words[order, word ^ 1]
        self.mates = mates.view(np.uint64).reshape(-1, self.width // 4)
        self.far = np.ascontiguousarray(points[:, 1 - word // 4])


_FOUR = np.uint64(0x0001000100010001)


def _by_words(queries: np.ndarray, points: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, point row, distance) of all that lie within the radius, in pieces, each pair once.

    For every word and each way to change up to its limit of bits, a query meets the
    bucket of the points with the changed word, a row of it at a time; those whose quarter
    keeps its limit too are compared whole. A pair is given at the first word that finds it.
    Queries go in the order of the word, so that those of a chunk meet the same few buckets.
    """
    if not len(queries) or not len(points):
        return
    for word, most, quarter in _word_limits(radius):
        asked = queries.view(np.uint16)[:, word]
        buckets = _Buckets(points, word, asked)
        step = max(1, 8 * _CHUNK // buckets.width)
        room = np.empty((min(step, len(queries)), buckets.width // 4), dtype=np.uint64)
        near = np.empty((len(room), buckets.width), dtype=bool)
        order = np.argsort(asked, kind="stable")
        for start in range(0, len(queries), step):
            turn = order[start : start + step]
            some = queries.take(turn, axis=0)
            own, mates = some.view(np.uint16)[:, word].astype(np.int64), some.view(np.uint16)[:, word ^ 1] * _FOUR
            mates = np.repeat(mates[:, None], room.shape[1], axis=1)
            far = np.ascontiguousarray(some[:, 1 - word // 4])
            pairs, held = [], 0
            for mask in _masks(most):
                left = quarter - int(mask).bit_count()
                for group, of in _groups(buckets, own ^ mask, len(room)):
                    pairs.append(_alike(buckets, group, mates if of is None else mates.take(of, axis=0), of, far, left, radius, room[: len(group)], near[: len(group)]))
                    held += len(pairs[-1][0])
                    if held > _CHUNK:
                        yield from _whole(queries, turn, points, pairs, word, radius)
                        pairs, held = [], 0
            yield from _whole(queries, turn, points, pairs, word, radius)


def _groups(buckets: _Buckets, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(row of the buckets, number of the query or None for all in turn) of what the queries look up, at most so many in a piece."""
    yield at, None
    long = np.flatnonzero(buckets.any_more.take(at, mode="clip"))
    key = at.take(long)
    more = buckets.more.take(key)
    ends = np.cumsum(more)
    first, total = buckets.first.take(key) - ends + more, int(ends[-1]) if len(ends) else 0
    for i in range(0, total, most):
        row = np.arange(i, min(i + most, total))
        of = np.searchsorted(ends, row, side="right")
        yield first.take(of) + row, long.take(of)


def _whole(queries: np.ndarray, turn: np.ndarray, points: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], word: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs found by a word, with their distance, those within the radius that no earlier word finds."""
    if not pairs:
        return
    q, p = (np.concatenate(x) for x in zip(*pairs, strict=True))
    q = turn.take(q)
    bits = queries.take(q, axis=0)
    bits ^= points.take(p, axis=0)
    d = np.bitwise_count(bits[:, 0]) + np.bitwise_count(bits[:, 1])
    hit = np.flatnonzero(d <= radius)
    if word and len(hit):
        words = np.bitwise_count(bits.take(hit, axis=0).view(np.uint8).reshape(len(hit), 8, 2))
        words = words[..., 0] + words[..., 1]
        again = np.zeros(len(hit), dtype=bool)
        for w, most, quarter in _word_limits(radius):
            if w < word:
                again |= (words[:, w] <= most) & (words[:, w] + words[:, w ^ 1] <= quarter)
        hit = hit[~again]
    if len(hit):
        yield q.take(hit), p.take(hit), d.take(hit).astype(np.int32)


def _alike(buckets: _Buckets, group: np.ndarray, mates: np.ndarray, of: np.ndarray | None, far: np.ndarray, left: int, radius: int, room: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) of those in the rows of the buckets whose other word is at most ``left`` bits from the query's, and whose far half at most the radius."""
    x = buckets.mates.take(group, axis=0, mode="clip", out=room)
    x ^= mates
    np.bitwise_count(x.view(np.uint8), out=x.view(np.uint8))
    both = x.view(np.uint16)
    both *= np.uint16(257)  # the high byte is now the sum of the two
    near = np.less(both, np.uint16((left + 1) << 8), out=near).reshape(-1)
    lanes = 8 if buckets.width > 4 else 4
    some = np.flatnonzero(near.view(np.uint64 if lanes == 8 else np.uint32) != 0)
    lane = np.flatnonzero(near.reshape(-1, lanes).take(some, axis=0))
    lane = some.take(lane // lanes) * lanes + lane % lanes
    q, place = lane // buckets.width, lane % buckets.width
    p = buckets.rows.take(group.take(q) * buckets.width + place)
    if of is not None:
        q = of.take(q)
    hit = np.flatnonzero((np.bitwise_count(far.take(q) ^ buckets.far.take(p, mode="clip")) <= radius) & (p >= 0))
    return q.take(hit), p.take(hit)


class ShardTree:
    """A vantage-point tree over shards: which one a fingerprint lies in, and which others may hold one within the radius of it.

    An inner node keeps a vantage point from the sample and the median distance to it. A
    fingerprint goes down one side, and up to the radius beyond the median it is asked for on the
    other one too. A leaf that no vantage point can split is cut into parts by hash.
    """

    def __init__(self, sample: np.ndarray, rows: int, shard_rows: int):
        self.nodes: list = []
        self.parts: list[int] = []
        self._grow(sample, rows / max(1, len(sample)), shard_rows)
        self.first = np.concatenate(([0], np.cumsum(self.parts)))
        self.shards = int(self.first[-1])

    def _grow(self, sample: np.ndarray, each: float, shard_rows: int) -> int:
        here = len(self.nodes)
        self.nodes.append(None)
        if len(sample) * each > shard_rows and len(sample) > 1:
            for vantage in sample[:8]:
                far = distances(sample, vantage)
                middle = int(np.median(far))
                near = far <= middle
                if 0.1 < near.mean() < 0.9:
                    self.nodes[here] = (vantage, middle, self._grow(sample[near], each, shard_rows), self._grow(sample[~near], each, shard_rows))
                    return here
        self.nodes[here] = len(self.parts)
        self.parts.append(max(1, round(len(sample) * each / (2 * shard_rows))))
        return here

    def place(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(own shard, (points, shards) whether a shard may hold something within the radius)."""
        own, reach = np.zeros(len(points), dtype=np.int64), np.zeros((len(points), self.shards), dtype=bool)
        salt = tb.mix(points[:, 0] ^ points[:, 1])
        stack = [(0, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while stack:
            at, rows, inside = stack.pop()
            node = self.nodes[at]
            if isinstance(node, tuple):
                vantage, middle, near, far = node
                d = distances(points[rows], vantage)
                for child, go, within in ((near, d <= middle + radius, d <= middle), (far, d > middle - radius, d > middle)):
                    if go.any():
                        stack.append((child, rows[go], (inside & within)[go]))
                continue
            reach[rows, self.first[node] : self.first[node + 1]] = True
            mine = rows[inside]
            own[mine] = self.first[node] + (salt[mine] % np.uint64(self.parts[node])).astype(np.int64)
        return own, reach


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b, level) of the documents that have an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                prints, level = fingerprint(block.column("text"))
                signed = np.ascontiguousarray(prints.T).view(np.int64)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(signed[0]), pa.array(signed[1]), pa.array(level)], ["doc_id", "a", "b", "level"])

    named = docs.select(F.col(doc_id).try_cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return named.mapInArrow(run, "doc_id bigint, a bigint, b bigint, level int")


def _asked(points: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(pair, alone, side, id, a, b, w): groups in which every two fingerprints meet that the bounds of their shards don't keep apart, once.

    Shards lie on a circle. A shard asks itself and the half of the circle that follows it,
    all at once or in as few blocks as :data:`MOST_POINTS` allows; a group is a shard and such
    a block. In the first one, ``alone``, the rows without ``side`` ask all rows, themselves
    among them; in others those with ``side`` ask the rest.
    """
    n = points.count()
    shard_rows = max(shard_rows, min(n // FEW_SHARDS, MOST_SHARD_ROWS))
    chosen = points.select("a", "b").orderBy(F.xxhash64("a", "b")).limit(SAMPLE_ROWS).toArrow() if n > shard_rows else None
    sample = _matrix(chosen) if chosen is not None else np.zeros((0, 2), dtype=np.uint64)
    layout = ShardTree(sample, n, shard_rows)
    ahead = layout.shards // 2 + 1
    blocks = -(-ahead // max(1, MOST_POINTS * layout.shards // max(1, n)))
    width = -(-ahead // blocks)
    tree = points.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = tree.value.shards
        for batch in batches:
            own, reach = tree.value.place(_matrix(batch), radius)
            reach[np.arange(len(own)), own] = True
            row, other = np.nonzero(reach)
            steps = (own[row] - other) % shards
            sent = (2 * steps < shards) | ((2 * steps == shards) & (other < own[row]))
            meets = (other - own[row]) % shards
            asks = (meets >= width) & ((2 * meets < shards) | ((2 * meets == shards) & (own[row] < other)))
            asking = np.unique(row[asks] * blocks + meets[asks] // width)
            asker, block = np.divmod(asking, blocks)
            row, other, steps = row[sent], other[sent], steps[sent]
            group = np.concatenate([other * blocks + steps // width, own[asker] * blocks + block])
            first = np.concatenate([steps < width, np.zeros(len(asker), dtype=bool)])
            side = np.concatenate([(steps > 0) & (steps < width), np.ones(len(asker), dtype=bool)])
            taken = pa.array(np.concatenate([row, asker]))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(first), pa.array(side), *[batch.column(c).take(taken) for c in ("id", "a", "b", "w")]], ["pair", "alone", "side", "id", "a", "b", "w"])

    return points.select("id", "a", "b", "w").mapInArrow(run, "pair bigint, alone boolean, side boolean, id bigint, a bigint, b bigint, w bigint")


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in "ab"], axis=1)


def _hits(table: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance) of the pairs within the radius, in pieces: those between the two sides of a group, or, in one that is alone, those of one side and between it and the other."""
    side, prints = table.column("side").to_numpy(), _matrix(table)
    alone = table.column("alone")[0].as_py()
    asked, within = (np.flatnonzero(~side), np.arange(len(side))) if alone else (np.flatnonzero(side), np.flatnonzero(~side))
    if not len(asked) or not len(within):
        return
    for q, p, d in VantagePointTree(prints[within]).within(prints[asked], radius):
        q, p = asked[q], within[p]
        if alone:
            once = side[p] | (q < p)
            q, p, d = q[once], p[once], d[once]
        yield q, p, d


def near_fingerprints(points: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All pairs (left, right, distance) of the distinct fingerprints ``points`` (id, a, b) within the radius.

    A tree of vantage points cuts the fingerprints into shards; a shard and some others are a
    group, to which each sends what lies near enough to the bounds of those that it meets there.
    A task builds a vantage-point tree of the others and asks it for the one.
    """

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        found = [(np.minimum(ids[q], ids[p]), np.maximum(ids[q], ids[p]), d) for q, p, d in _hits(table, radius)]
        left, right, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
        return pa.table({"left": left, "right": right, "distance": d.astype(np.int32)})

    asked = _asked(points.withColumn("w", F.lit(1).cast("bigint")), radius, shard_rows)
    return asked.groupBy("pair").applyInArrow(search, "left bigint, right bigint, distance int")


def near_links(points: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, n, root) of the fingerprints ``points`` (id, a, b, w) that have one within the radius, some rows an id.

    Over all rows of an id, ``n`` adds up to the weights of all fingerprints within
    the radius of it, and edges from id to ``root`` connect what pairs would. The
    same search as that of :func:`near_fingerprints`, but what leaves a task is at most one
    row for each fingerprint that entered, however many pairs there are.
    """

    def search(table: pa.Table) -> pa.Table:
        ids, w = table.column("id").to_numpy(), table.column("w").to_numpy()
        n, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for q, p, _ in _hits(table, radius):
            np.add.at(n, q, w[p])
            np.add.at(n, p, w[q])
            while True:
                a, b = root[q], root[p]
                if (a == b).all():
                    break
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
        some = np.flatnonzero(n)
        return pa.table({"id": ids[some], "n": n[some], "root": ids[root[some]]})

    return _asked(points, radius, shard_rows).groupBy("pair").applyInArrow(search, "id bigint, n bigint, root bigint")


def _classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, a, b, level), and classes of equal fingerprints (a, b, level, first, w): the least id and the number of documents."""
    prints = Table(fingerprints(docs, doc_id, text).distinct(), "simhash").df
    return prints, Table(prints.groupBy("a", "b", "level").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("w")), "simhash-classes").df


def _points(classes: DataFrame) -> DataFrame:
    return classes.where("level = 0").select(F.col("first").alias("id"), "a", "b", "w")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Near-duplicate pairs (doc_id, near_id, distance), doc_id < near_id.

    Documents with one and the same fingerprint are listed once each, as pairs with
    the least id among them at distance 0, and that id stands for all of them in the
    pairs with other fingerprints. Cases are those of :func:`near_classes`; where
    copies differ a little from one another the pairs grow with their number's square, so for
    large tables that one is the query.
    """
    prints, classes = _classes(docs, doc_id, text)
    copies = prints.join(classes, ["a", "b", "level"]).where("doc_id <> first").select(F.col("first").alias("doc_id"), F.col("doc_id").alias("near_id"), F.lit(0).alias("distance"))
    pairs = near_fingerprints(_points(classes), radius, shard_rows).where("left <> right")
    return copies.unionByName(pairs.select(F.col("left").alias("doc_id"), F.col("right").alias("near_id"), "distance"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, class_id, links) of the documents that have a near duplicate.

    Two documents are near if their fingerprints differ in at most ``radius`` of 128
    bits, whatever their lengths. ``class_id`` is the least id of those that a chain of
    near pairs connects, and ``links`` how many documents are near this one, equal
    ones included; documents without a link have no row. The search is exact: no pair
    within the radius is missed.

    Ids are whole numbers. Rows with a null id, one that isn't a whole number or a null
    text are in no class; repeated rows are one document, and so are rows with the same id
    and several texts: it connects them, and has the links of all of them. An empty text
    equals any other empty text; texts without a letter or digit are near only if
    equal; very long texts are fingerprinted whole. Extra columns of any name are
    ignored; empty input gives no rows.
    """
    prints, classes = _classes(docs, doc_id, text)
    links = Table(near_links(_points(classes), radius, shard_rows), "simhash-links")
    found = links.df
    several = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    several = prints.join(several, "doc_id").join(classes, ["a", "b", "level"]).select(F.col("first").alias("left"), F.col("doc_id").alias("right"))
    stars = components_table(found.where("id <> root").select(F.col("root").alias("left"), F.col("id").alias("right")).unionByName(several))
    group = members(stars.df)
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(n, F.col("first") == F.col("id"), "left").drop("id").join(group, F.col("first") == F.col("node"), "left")
    known = known.select("a", "b", "level", F.coalesce("component", "first").alias("class_id"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("links")).where("links > 0 OR class_id IS NOT NULL")
    known = Table(known, "simhash-known", after=[links, stars])
    rows = prints.join(known.df, ["a", "b", "level"])
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links")).where("links > 0")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, group_id) of the documents that have a near duplicate; group_id is the least id of the connected group. Cases are those of :func:`near_classes`."""
    return near_classes(docs, doc_id, text, radius, shard_rows).select("doc_id", F.col("class_id").alias("group_id"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``docs`` without all but one document (the least id) of each near-duplicate group, with all their columns.

    Rows without a whole number as id or without a text stay. Of rows alike in id and
    text one stays; of two texts with one id both or neither. All else is as in
    :func:`near_classes`: texts of any length count whole, an empty table comes back empty, and
    columns may have any names. The ids to drop are written first, so that Spark
    broadcasts them only if their size is below the session's threshold.
    """
    out = Table(near_groups(docs, doc_id, text, radius, shard_rows).where("doc_id <> group_id").select(F.col("doc_id").alias("out")), "near-out").df
    key = F.col(f"row.`{doc_id}`").try_cast("bigint")
    rows = docs.select(F.struct("*").alias("row"))
    kept = rows.join(out, key == F.col("out"), "left_anti")
    again = rows.select(key.alias("again")).where("again IS NOT NULL").groupBy("again").count().where("count > 1").select("again")
    again = Table(again, "near-again").df
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, key == F.col("again"), "left_anti")
    repeated = kept.join(again, key == F.col("again"), "left_semi").select("row.*").dropDuplicates([doc_id, text])
    return once.select("row.*").unionByName(repeated)
