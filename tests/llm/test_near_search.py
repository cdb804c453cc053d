"""The search of operator 10 among fingerprints far from one another, where the triangle bound excludes next to nothing."""

import numpy as np
import pyarrow as pa
import pytest
from fixtures import prose

from quarry.llm import simhash


def spread(r, n):
    return r.integers(0, 1 << 64, (n, 2), dtype=np.uint64)


def changed(r, points, most):
    """The points with up to so many bits changed each, both ends of the range among them."""
    out = points.copy()
    for i in range(len(out)):
        for bit in r.choice(128, (0, most)[i] if i < 2 else r.integers(0, most + 1), replace=False):
            out[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


def found(queries, points, radius):
    pieces = [np.stack(x) for x in simhash.VantagePointTree(points).within(queries, radius)]
    return sorted(zip(*np.concatenate([np.zeros((3, 0), dtype=np.int64), *pieces], axis=1).tolist(), strict=True))


def brute(queries, points, radius):
    d = np.bitwise_count(queries[:, None] ^ points).sum(axis=-1)
    return sorted((int(q), int(p), int(d[q, p])) for q, p in zip(*np.nonzero(d <= radius), strict=True))


class Counted:
    """numpy, with a count of the bytes whose bits it counts."""

    def __init__(self):
        self.bytes = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def bitwise_count(self, x, *args, **named):
        self.bytes += x.nbytes
        return np.bitwise_count(x, *args, **named)


def test_far_points_are_not_all_compared(monkeypatch):
    r = np.random.default_rng(11)
    points = spread(r, 30_000)
    queries = np.concatenate([spread(r, 29_000), changed(r, points[:1000], 26)])
    counted = Counted()
    monkeypatch.setattr(simhash, "np", counted)
    got = found(queries, points, 24)
    monkeypatch.undo()
    assert counted.bytes < 0.1 * 8 * len(queries) * len(points)
    want = brute(queries[-300:], points, 24)
    assert [x for x in got if x[0] >= len(queries) - 300] == [(len(queries) - 300 + q, p, d) for q, p, d in want]
    near = simhash.distances(queries[-1000:], points[:1000])
    assert {(29_000 + int(i), int(i), int(near[i])) for i in np.flatnonzero(near <= 24)} <= set(got) and len(got) > 800


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 24, 27])
@pytest.mark.parametrize("chunk", [64, 32_768])
@pytest.mark.parametrize("shape", ["spread", "ball", "clusters", "one half", "none"])
def test_search_by_words_is_exact(monkeypatch, shape, chunk, radius):
    if chunk == 64 and radius > 4:
        radius = 12
    monkeypatch.setattr(simhash, "_CHUNK", chunk)
    r = np.random.default_rng(12)
    points = {"spread": spread(r, 300), "ball": np.repeat(spread(r, 1), 300, axis=0), "clusters": np.repeat(spread(r, 20), 15, axis=0), "one half": spread(r, 300), "none": spread(r, 0)}[shape]
    if shape == "one half":
        points[:, 0] = points[:1, 0]
    points = changed(r, points, 14)
    queries = np.concatenate([changed(r, points[:60], 26), points[:60], spread(r, 30)])
    got = [x for q, p, d in simhash._by_words(queries, points, radius) for x in zip(q.tolist(), p.tolist(), d.tolist(), strict=True)]
    assert sorted(got) == brute(queries, points, radius)


def test_search_is_chosen_by_what_it_costs():
    r = np.random.default_rng(13)
    points = spread(r, 30_000)
    rows = np.arange(len(points))
    assert simhash._words_pay(points, rows, points, rows, 24)
    assert not simhash._words_pay(points, rows[:50], points, rows, 24) and not simhash._words_pay(points, rows, points, rows[:1000], 24)
    same = points.copy()
    same[:, 0] = same[0, 0]
    assert not simhash._words_pay(same, rows, same, rows, 24)
    assert not simhash._words_pay(points, rows, points, rows, 60)


@pytest.mark.parametrize("alone", [True, False])
def test_tasks_of_the_near_duplicates_stage(monkeypatch, alone):
    r = np.random.default_rng(14)
    n = 40_000
    points = spread(r, n)
    points[n // 2 : n // 2 + 200] = changed(r, points[:200], 26)
    side = np.arange(n) >= n // 2
    a, b = points.view(np.int64).T
    table = pa.table({"id": np.arange(n), "a": np.ascontiguousarray(a), "b": np.ascontiguousarray(b), "side": side & (not alone), "alone": np.full(n, alone)})
    counted = Counted()
    monkeypatch.setattr(simhash, "np", counted)
    got = [x for q, p, d in simhash._hits(table, 24) for x in zip(np.minimum(q, p).tolist(), np.maximum(q, p).tolist(), d.tolist(), strict=True)]
    monkeypatch.undo()
    assert counted.bytes < 0.2 * 8 * (n * n if alone else n * n // 4)
    near = simhash.distances(points[:200], points[n // 2 : n // 2 + 200])
    assert sorted(got) == [(i, n // 2 + i, int(near[i])) for i in range(200) if near[i] <= 24]


def test_stage_over_far_texts_keeps_what_a_loop_keeps(spark):
    r = np.random.default_rng(15)
    words = [prose(f"w{i}", 30) for i in range(40)]
    texts = [" ".join(f"t{x:x}" for x in r.integers(0, 1 << 40, 12)) for _ in range(11_800)]
    texts += [t + " end" for t in texts[:100]] + words + words[:20]
    prints = np.concatenate([simhash.fingerprint(pa.array(texts[i : i + 8000]))[0] for i in range(0, len(texts), 8000)])  # a block has 8192 rows at most
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in np.flatnonzero(simhash.distances(prints[:i], prints[i]) <= simhash.RADIUS):
            x, y = sorted((top(i), top(int(j))))
            group[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id for x in simhash.near_dedup(docs, shard_rows=20_000).select("doc_id").collect()}
    assert got == {i for i in range(len(texts)) if top(i) == i} and len(got) < len(texts) - 60


@pytest.mark.parametrize("most", [100, 700, 1_000_000])
@pytest.mark.parametrize("shard_rows", [150, 250, 5000])
def test_each_two_shards_of_the_near_duplicates_stage_meet_once(spark, monkeypatch, most, shard_rows):
    monkeypatch.setattr(simhash, "MOST_POINTS", most, raising=False)
    r = np.random.default_rng(16)
    points = spread(r, 2000)
    points[1000:1400] = changed(r, points[:400], 26)
    n = len(points)
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(points.view(np.int64).tolist())], "id bigint, a bigint, b bigint")
    sent = simhash._asked(table.selectExpr("*", "1L AS w"), 24, shard_rows).toArrow()
    if most == 1_000_000 and shard_rows < n:
        own = sent.filter(sent["alone"]).num_rows
        shards = len(set(sent["pair"].to_pylist()))
        assert shards > 7 and own == sent.num_rows <= n * (shards // 2 + 1)
    meetings = np.zeros((n, n), dtype=np.uint8)
    for pair in set(sent["pair"].to_pylist()):
        rows = [x for x in zip(sent["pair"].to_pylist(), sent["id"].to_pylist(), sent["side"].to_pylist(), sent["alone"].to_pylist(), strict=True) if x[0] == pair]
        ids, side, alone = np.array([x[1] for x in rows]), np.array([x[2] for x in rows]), rows[0][3]
        assert {x[3] for x in rows} == {alone}
        if alone:
            own = ids[~side]
            meetings[np.ix_(own, own)] += 1 - np.eye(len(own), dtype=np.uint8)
        meetings[np.ix_(ids[side], ids[~side])] += 1
        meetings[np.ix_(ids[~side], ids[side])] += 1
    near = np.bitwise_count(points[:, None] ^ points).sum(axis=-1) <= 24
    np.fill_diagonal(near, False)
    assert (meetings[near] == 1).all() and meetings.max() == 1
    got = sorted((x.left, x.right, x.distance) for x in simhash.near_fingerprints(table, 24, shard_rows).collect())
    assert got == [x for x in brute(points, points, 24) if x[0] < x[1]] and len(got) > 300
