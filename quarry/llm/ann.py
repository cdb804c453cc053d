"""Approximate nearest neighbours on robust-pruned directed graphs (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Table

#: Neighbours found for each vector.
K = 10
#: Edges of a node, width of the beam in searches and while building, and the slack of the pruning rule.
DEGREE, BEAM, BUILD_BEAM, ALPHA = 24, 72, 40, 1.2
#: Vectors in a shard, each a graph of its own: at least so many while there are fewer shards than cores, at most so many beyond.
SHARD_ROWS, MOST_SHARD_ROWS = 4096, 262_144
#: Nodes that a search follows at a time.
EXPAND = 4
_BATCH = 512
#: Cells of the table of visited nodes.
_CELLS = 1 << 25


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def beam_search(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, width) nodes and squared distances, nearest first, -1 where fewer were met.

    Greedy search: each query keeps the ``width`` nearest nodes met so far and
    always follows the edges of the nearest that it hasn't followed yet, a few at
    a time, until none is left. All queries of the batch take a step together, and a
    distance is computed once for each node that a query meets.
    """
    m, n = len(queries), len(x)
    node, dist, fresh = np.full((m, width), -1, dtype=np.int64), np.full((m, width), np.inf, dtype=np.float32), np.zeros((m, width), dtype=bool)
    own = np.einsum("ij,ij->i", queries, queries)
    node[:, 0], dist[:, 0], fresh[:, 0] = entry, _squared(x[entry], queries), True
    visited = np.zeros((m, n), dtype=bool)
    visited[:, entry] = True
    live = np.arange(m)
    while len(live):
        ahead = np.where(fresh[live], dist[live], np.inf)
        pick = np.argpartition(ahead, EXPAND, axis=1)[:, :EXPAND] if width > EXPAND else np.broadcast_to(np.arange(width), ahead.shape)
        some = np.isfinite(np.take_along_axis(ahead, pick, axis=1))
        row, place = np.nonzero(some)
        at = pick[row, place]
        fresh[live[row], at] = False
        target = edges[node[live[row], at]]
        row = np.repeat(row, target.shape[1])
        target = target.ravel()
        new = target >= 0
        row, target = row[new], target[new]
        new = ~visited[live[row], target]
        key = np.sort(row[new] * n + target[new])
        row, target = np.divmod(key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key, n)
        if len(row):
            visited[live[row], target] = True
            d = norms[target] + own[live[row]] - 2 * np.einsum("ij,ij->i", x[target], queries[live[row]])
            counts = np.bincount(row, minlength=len(live))
            pad_d, pad_n = np.full((len(live), counts.max()), np.inf, dtype=np.float32), np.full((len(live), counts.max()), -1, dtype=np.int64)
            spot = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            pad_d[row, spot], pad_n[row, spot] = d, target
            all_d = np.concatenate([dist[live], pad_d], axis=1)
            order = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            dist[live] = np.take_along_axis(all_d, order, axis=1)
            node[live] = np.take_along_axis(np.concatenate([node[live], pad_n], axis=1), order, axis=1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], np.isfinite(pad_d)], axis=1), order, axis=1)
        live = live[fresh[live].any(axis=1)]
    order = np.argsort(dist, axis=1, kind="stable")
    node, dist = np.take_along_axis(node, order, axis=1), np.take_along_axis(dist, order, axis=1)
    node[np.isinf(dist)] = -1
    return node, dist


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(points, degree) neighbours from (points, c) candidates, -1 for none.

    The nearest candidate becomes a neighbour and strikes out all that are ``alpha``
    times nearer to it than to the point, and so on: edges that lead the same way as a
    shorter one go, long edges in other directions stay.
    """
    m = len(points)
    out = np.full((m, degree), -1, dtype=np.int64)
    ordered = np.sort(candidates, axis=1)
    void = ordered == points[:, None]
    void[:, 1:] |= ordered[:, 1:] == ordered[:, :-1]
    void |= ordered < 0
    vectors, norm = x[ordered], norms[ordered]
    d = np.maximum(norm + norms[points][:, None] - 2 * np.matmul(vectors, x[points][:, :, None])[:, :, 0], 0)
    d[void] = np.inf
    gram = vectors @ vectors.transpose(0, 2, 1)
    rows = np.arange(m)
    for k in range(degree):
        pick = d.argmin(axis=1)
        has = np.isfinite(d[rows, pick])
        if not has.any():
            break
        out[has, k] = ordered[rows, pick][has]
        between = norm + norm[rows, pick][:, None] - 2 * gram[rows, pick]
        d[(alpha * alpha * between <= d) & has[:, None]] = np.inf
        d[rows, pick] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, int]:
    """(n, degree) edges and the entry node of a graph over distinct vectors.

    Two passes over the points in random order, the first with alpha 1: greedy
    searches propose candidates, pruning chooses among them and the present
    edges, and each chosen edge is offered the other way round: added where there is room,
    and else pruned with those that are there.
    """
    n = len(x)
    random = np.random.default_rng(seed)
    norms = np.einsum("ij,ij->i", x, x)
    entry = int(_squared(x, x.mean(axis=0)).argmin())
    if n <= degree + 1:
        full = np.array([[j for j in range(n) if j != i] + [-1] * (degree - n + 1) for i in range(n)], dtype=np.int64)
        return full.reshape(n, degree), entry
    edges = np.full((n, degree), -1, dtype=np.int64)
    edges[:, : degree // 2] = random.integers(0, n, (n, degree // 2))
    batch = max(1, min(_BATCH, _CELLS // n))
    for slack in (1.0, alpha):
        order = random.permutation(n)
        for i in range(0, n, batch):
            points = order[i : i + batch]
            met, _ = beam_search(x, norms, edges, entry, x[points], width)
            edges[points] = robust_prune(x, norms, points, np.concatenate([met, edges[points]], axis=1), degree, slack)
            source, target = np.repeat(points, degree), edges[points].ravel()
            new = target >= 0
            source, target = source[new], target[new]
            new = ~(edges[target] == source[:, None]).any(axis=1)
            source, target = source[new], target[new]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            goals, first, counts = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, counts)
            has = (edges[goals] >= 0).sum(axis=1)  # the edges of a node stand before its empty places
            room = has + counts <= degree
            fits = np.repeat(room, counts)
            edges[target[fits], (np.repeat(has, counts) + place)[fits]] = source[fits]
            goals, counts, source, place = goals[~room], counts[~room], source[~fits], place[~fits]
            if not len(goals):
                continue
            offered = np.full((len(goals), int(counts.max())), -1, dtype=np.int64)
            offered[np.repeat(np.arange(len(goals)), counts), place] = source
            step = max(1, (1 << 22) // (offered.shape[1] + degree) ** 2)
            for j in range(0, len(goals), step):
                some = goals[j : j + step]
                edges[some] = robust_prune(x, norms, some, np.concatenate([edges[some], offered[j : j + step]], axis=1), degree, slack)
    return edges, entry


def vectors_of(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): one usable vector for each id, the least if it has several; usable are those of the most frequent length without a null or a number that isn't finite."""
    rows = table.select(F.col(vec_id).try_cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common.n if common else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


class _Shard:
    """The graph of a shard and the ids that hold each of its vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, degree: int, alpha: float):
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.edges, self.entry = build_graph(self.x, degree, alpha=alpha)
        inverse = inverse.ravel()
        order = np.argsort(inverse, kind="stable")
        place = np.arange(len(order)) - np.searchsorted(inverse[order], inverse[order])
        order = order[place <= k]  # the least k + 1 ids of a vector are all that a result can hold
        self.held, self.first = ids[order], np.searchsorted(inverse[order], np.arange(len(self.x) + 1))

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, neighbor, distance) of the k best of this shard."""
        node, _ = beam_search(self.x, self.norms, self.edges, self.entry, queries, width)
        row, place = np.nonzero(node[:, : 2 * (k + 1)] >= 0)
        found = node[row, place]
        sizes = self.first[found + 1] - self.first[found]
        at = np.arange(int(sizes.sum())) + np.repeat(self.first[found] - (np.cumsum(sizes) - sizes), sizes)
        exact = np.sqrt(_squared(self.x[found].astype(np.float64), queries[row].astype(np.float64)))
        owner, other, far = np.repeat(row, sizes), self.held[at], np.repeat(exact, sizes)
        keep = ids[owner] != other
        owner, other, far = owner[keep], other[keep], far[keep]
        by = np.lexsort((other, far, owner))
        owner, other, far = owner[by], other[by], far[by]
        best = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
        return ids[owner[best]], other[best], far[best]


def _search(k: int, degree: int, width: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is a shard: first its vectors, then the queries, of which no more than a batch is held
        ids, vectors, shard = [], [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            own = batch.filter(pa.array(~asks))
            if len(own):
                ids.append(own.column("id").to_numpy())
                vectors.append(_matrix(own.column("v")))
            asked = batch.filter(pa.array(asks))
            if not len(asked) or not ids:
                continue
            if shard is None:
                shard = _Shard(np.concatenate(ids), np.concatenate(vectors), k, degree, alpha)
                vectors.clear()
            step = max(1, min(_BATCH, _CELLS // len(shard.x)))
            for i in range(0, len(asked), step):
                some = asked.slice(i, step)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, shard.nearest(some.column("id").to_numpy(), _matrix(some.column("v")), k, width))), ["id", "neighbor", "distance"])

    return run


def nearest_neighbors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = 1, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_SHARD_ROWS) -> DataFrame:
    """The k nearest other vectors of the vectors whose id is divisible by ``every``: (vec_id, neighbor_id, distance, rank), Euclidean, ranks from 1.

    All vectors are indexed, and those that ask are put to all of them. Vectors go
    to shards by hash of the id, each shard is made a graph, and every query
    is put to every shard by beam search; the best k of all shards remain, ties
    by id. Equal vectors are one node of a graph that lists its least k + 1 ids, so
    any number of them neither cuts the graph nor fills the beam.

    Ids are whole numbers. Rows with a null id or another one, a null or empty vector, a
    null or infinite element or NaN, or not of the most frequent length are left
    out; of several rows of one id the least vector counts. With fewer than k + 1 ids
    there are fewer ranks; empty input gives no rows. Extra columns of any name are ignored.

    Approximate: tests hold recall against brute force at 0.9 and more. A shard is a
    partition and a task, whatever the session's settings, that reads the vectors,
    builds the graph in memory, and streams the queries past it. There are as many
    shards as cores, as soon as they have ``shard_rows`` vectors, and more once they would exceed ``most_rows``:
    the work is linear for the graphs, and queries times shards for the searches.
    """
    k = max(1, k)
    width = max(width, 2 * (k + 1))
    vectors = Table(vectors_of(table, vec_id, embedding), "vectors").df
    n = vectors.count()
    shards = max(1, -(-n // most_rows), min(-(-n // shard_rows), vectors.sparkSession.sparkContext.defaultParallelism))
    own = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    asked = vectors.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    placed = own.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("asks").select("asks", "id", "v")
    found = placed.mapInArrow(_search(k, degree, width, alpha), "id bigint, neighbor bigint, distance double")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))).where(F.col("rank") <= k)
    return best.select(F.col("id").alias("vec_id"), F.col("neighbor").alias("neighbor_id"), "distance", "rank")
