import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, prose
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, fingerprints, groups, langid, line_dedup, mixing, quality, queries, simhash, suffix_dedup


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], DOCS)


# --- 1: nearest neighbours


def test_neighbours_recall(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(40, 24))[r.integers(0, 40, 3000)] + 0.4 * r.normal(size=(3000, 24))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = defaultdict(dict)
    for row in ann.nearest_neighbors(table, k=10, shard_rows=700, most_rows=900).collect():
        got[row.vec_id][row.rank] = (row.neighbor_id, row.distance)
    hits = 0
    for i in range(len(x)):
        d = ((x - x[i]).astype(np.float64) ** 2).sum(axis=1)
        d[i] = np.inf
        best = set(np.argpartition(d, 10)[:10].tolist())
        hits += len(best & {n for n, _ in got[i].values()})
        assert sorted(got[i]) == list(range(1, 11)) and i not in {n for n, _ in got[i].values()}
    assert hits / (10 * len(x)) >= 0.9
    some = ann.nearest_neighbors(table, k=10, every=100, shard_rows=700, most_rows=900).collect()
    assert {r.vec_id for r in some} == set(range(0, 3000, 100)) and all(got[r.vec_id][r.rank] == (r.neighbor_id, r.distance) for r in some)


def test_op1_recall(spark):
    """The query itself, on a whole table, against brute force."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = defaultdict(set)
    for r in queries.op1_nearest_neighbors(spark, sf).collect():
        got[r.vec_id].add(r.neighbor_id)
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(got[ids[i]] & set(ids[np.argpartition(d, 10)[:10]].tolist()))
    assert len(got) == (ids % 100 == 0).sum() and hits / (10 * len(got)) >= 0.9


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (3, [0.0, 9.0]), (None, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [1.0]), (9, [0.0, None]), (1, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(0))
    got = sorted(map(tuple, ann.nearest_neighbors(table, k=2).collect()))
    assert got == [(1, 2, 0.0, 1), (1, 3, 9.0, 2), (2, 1, 0.0, 1), (2, 3, 9.0, 2), (3, 1, 9.0, 1), (3, 2, 9.0, 2)]
    assert ann.nearest_neighbors(table.limit(0)).count() == 0


# --- 2: suffix-array dedup


def brute_passages(texts, threshold):
    """The repeated positions of each document but those of the first."""
    seen, out = {}, defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - threshold + 1):
            gram = tuple(w[p : p + threshold])
            if gram in seen:
                out[i].add(p)
            else:
                seen[gram] = (i, p)
    return out


@pytest.mark.parametrize("threshold", [10, 50])
def test_repeated_passages(spark, threshold):
    shared = prose("shared", threshold + 17)
    texts = [prose(i, 90) for i in range(12)]
    texts[3] += " " + shared + " tail one"
    texts[7] = "head " + shared + " " + texts[7]
    texts[9] = shared + " x " + shared
    texts += ["one two " * 60, prose("short", threshold - 1), prose("short", threshold - 1)]
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs_of(spark, texts), threshold=threshold, rows_per_range=40).collect():
        got[r.doc_id] |= set(range(r.start_word, r.start_word + r.words - threshold + 1))
        at = texts[r.doc_id].split()[r.start_word : r.start_word + r.words]
        assert at == texts[r.first_doc_id].split()[r.first_word : r.first_word + r.words]
    assert got == brute_passages(texts, threshold)


def test_repeated_passages_odd(odd_docs, no_docs):
    rows = sorted(map(tuple, suffix_dedup.repeated_passages(odd_docs, threshold=10).collect()))
    assert rows == [(2, 0, 40, 1, 0)]
    assert suffix_dedup.repeated_passages(no_docs).count() == 0


# --- 4: mixing


def test_mixing_meets_its_budget(spark):
    rows = [(i, prose(i, 5 + i % 30), "en", "big" if i % 10 else "small", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.plan_mix(docs, {"big": 0.25, "small": 0.75}, 8000, rows_per_range=50)
    taken = {r.source: r.t for r in plan.groupBy("source").agg(F.sum("take").alias("t")).collect()}
    assert taken == {"big": 2000, "small": 6000}
    tokens = {r[0]: len(r[1].split()) for r in rows}
    for r in plan.where("epoch = 0").orderBy("source", "start").collect():
        assert r.tokens == tokens[r.doc_id]
    drawn = Counter(r.doc_id for r in plan.collect())
    again = Counter(r.doc_id for r in mixing.mix(docs, {"big": 0.25, "small": 0.75}, 8000).collect())
    assert drawn == again and {r.c for r in docs.select(F.count("*").alias("c")).collect()} == {600}


def test_mixing_odd(odd_docs, no_docs):
    plan = mixing.plan_mix(odd_docs).collect()
    assert {r.source for r in plan} == {"a", "b", None} and sum(r["take"] for r in plan) <= 30_000 + 400
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            mixing.plan_mix(odd_docs, bad)
    clash = odd_docs.selectExpr("cast(doc_id as string) AS key", "text AS take", "source AS row", "7 AS t", "8 AS times")
    drawn = mixing.mix(clash, doc_id="key", source="row", text="take")
    assert drawn.columns == clash.columns and drawn.count() == mixing.mix(odd_docs).count()
    assert mixing.plan_mix(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


# --- 5: fingerprints


def test_chunks_realign_and_partition():
    text = prose("chunks", 4000).encode()
    for shift in (0, 13):
        data = np.frombuffer(b"z" * shift + text, dtype=np.uint8)
        starts, ends = fingerprints.chunks(data, np.array([0, len(data)]))
        assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all() and (ends - starts).max() <= 512
    whole = {text[a:b] for a, b in zip(*fingerprints.chunks(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])), strict=True)}
    moved = b"z" * 13 + text
    other = {moved[a:b] for a, b in zip(*fingerprints.chunks(np.frombuffer(moved, dtype=np.uint8), np.array([0, len(moved)])), strict=True)}
    assert len(whole & other) > 0.9 * len(whole)


def slow_chunks(raw):
    least, normal, most = fingerprints.SIZES
    out, at = [], 0
    while at < len(raw):
        end = None
        for n in range(least, min(most, len(raw) - at) + 1):
            h = 0
            for b in raw[max(0, at + n - 32) : at + n]:
                h = ((h << 1) + int(fingerprints._GEAR[b])) & 0xFFFFFFFF
            if h >> (32 - fingerprints.BITS[0 if n < normal else 1]) == 0:
                end = at + n
                break
        end = end or min(at + most, len(raw))
        out.append((at, end))
        at = end
    return out


def test_chunks_against_a_loop():
    raw = prose("loop", 300).encode()
    starts, ends = fingerprints.chunks(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == slow_chunks(raw)


def test_containment(spark):
    base = prose("base", 900)
    texts = [base, prose("more", 600) + " " + base, prose("alone", 300), base]
    rows = {r.doc_id: r for r in fingerprints.corpus_containment(docs_of(spark, texts)).collect()}
    assert rows[0].containment == rows[3].containment == 1 and rows[0].container_id == 3 and rows[3].container_id == 0
    assert rows[2].containment == 0 and rows[2].container_id is None and 0.4 < rows[1].containment < 0.7 and rows[1].container_id == 0
    sets = {i: {texts[i].encode()[a:b] for a, b in slow_chunks(texts[i].encode())} for i in range(4)}
    shared = sum(len(c) for c in sets[1] if any(c in sets[j] for j in (0, 2, 3)))
    assert rows[1].shared_bytes == shared and rows[1].bytes == sum(map(len, sets[1]))
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 2)], "left bigint, right bigint")
    share = {(r.left, r.right): r.containment for r in fingerprints.containment(fingerprints.fingerprints(docs_of(spark, texts)), pairs).collect()}
    assert share[0, 1] > 0.9 > share[1, 0] > 0 == share[0, 2]


def test_containment_odd(odd_docs, no_docs):
    rows = fingerprints.corpus_containment(odd_docs).collect()
    ids = Counter(r.doc_id for r in rows)
    assert ids[1] == 2 and ids[3] == 0 and ids[4] == 1 and ids[None] == 1
    assert next(r for r in rows if r.doc_id == 4).containment is None and next(r for r in rows if r.doc_id == 2).container_id == 1
    assert fingerprints.corpus_containment(no_docs).count() == 0


# --- 6: BPE


def test_bpe_equals_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import sys

    sys.path.insert(0, "/opt/tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    alphabet = list("abst  \n\t'’.,019éßñ日本😀  ARE")
    texts = ["", " ", "it's we're I'll they've 's ' s", "a" * 3000, prose(2), "  x", "x  ", "a\n\n b", "don't'st''ve"] + ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(300)]
    rows = bpe.bpe_encode(docs_of(spark, texts)).collect()
    for row in rows:
        assert row.tokens == encoder.encode_ordinary(texts[row.doc_id]), texts[row.doc_id]
        assert row.round_trip and row.n_tokens == len(row.tokens)
    back = {x.doc_id: x.text for x in bpe.bpe_decode(bpe.bpe_encode(docs_of(spark, texts))).collect()}
    assert back == dict(enumerate(texts))


def test_bpe_odd(odd_docs, no_docs):
    named = odd_docs.selectExpr("doc_id", "source AS text", "text AS body", "1 AS row", "2 AS tokens")
    both = bpe.bpe_encode(named, "body", ("doc_id", "text", "row"))
    assert both.columns == ["doc_id", "text", "row", "n_tokens", "tokens", "round_trip"] and {r.text for r in both.collect()} == {"a", "b", None}
    again = bpe.bpe_decode(both.where("doc_id = 9 OR doc_id = 3"), keep=("row", "doc_id")).collect()
    assert sorted(((r.row, r.doc_id, r.text) for r in again), key=str) == [(1, 3, None), (1, 9, "é" * 50)]
    assert bpe.bpe_encode(odd_docs, keep=()).columns == ["n_tokens", "tokens", "round_trip"]
    out = bpe.bpe_encode(odd_docs, keep=("doc_id", "tokens", "kept"))
    assert out.columns == ["doc_id", "kept", "n_tokens", "tokens", "round_trip"] and out.count() == odd_docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].tokens is None and rows[3].round_trip is None and rows[4].tokens == [] and rows[7].n_tokens > 30_000
    assert bpe.bpe_encode(no_docs).count() == 0 and bpe.bpe_decode(bpe.bpe_encode(no_docs)).count() == 0


# --- 7: line dedup


def test_line_dedup(spark):
    rows = [(i, f"menu\nline {i}\n\n menu \nend {i % 3}", "en", "big" if i < 40 else "small", 0) for i in range(44)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[3].text == "line 3\n" and out[3].dropped_lines == 3 and out[41].text == "line 41\n\nend 2" and out[41].dropped_lines == 2


def test_line_dedup_odd(odd_docs, no_docs):
    out = line_dedup.line_dedup(odd_docs)
    assert sorted(out.columns) == sorted(odd_docs.columns) and dict(out.dtypes)["dropped_lines"] == "bigint" and out.count() == odd_docs.count()
    assert {r.text for r in out.where("doc_id = 3").collect()} == {None} and sorted(r.doc_id for r in out.where("dropped_lines > 0").collect()) == [1, 1]
    assert line_dedup.line_dedup(no_docs).count() == 0


# --- 8: language ID


def test_marginals_against_enumeration():
    import itertools

    r = np.random.default_rng(0)
    scores, transitions = r.normal(size=(6, 3)), r.normal(size=(3, 3))
    mass = np.zeros((6, 3))
    for path in itertools.product(range(3), repeat=6):
        # before the first word stands one whose language isn't known
        start = np.exp(transitions[:, path[0]]).sum()
        w = start * np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            mass[i, y] += w
    got = langid.marginals(scores, np.array([0, 6]), transitions)
    assert np.allclose(got, mass / mass.sum(axis=1, keepdims=True))
    long = langid.marginals(np.tile(scores, (50, 1)), np.array([0, 0, 300]), transitions)
    assert np.allclose(long.sum(axis=1), 1) and langid.marginals(scores[:0], np.array([0]), transitions).shape == (0, 3)


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 40")
    train, test = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    model = langid.train(train, sample=250)
    rows = langid.language_id(test, model=model).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.detected == r.lang for r in rows]) > 0.9
    known = {x: [r.text for r in train.where(F.col("lang") == x).limit(3).collect()] for x in ("en", "de")}
    en, de = known["en"][0].split()[:30], known["de"][0].split()[:30]
    words = langid.label_texts(model, pa.array([" ".join(en + de)]))[2]
    truth = [model.langs.index("en")] * len(langid.words_of(pa.array([" ".join(en)]))[1])
    truth += [model.langs.index("de")] * (len(words) - len(truth))
    assert np.mean(words == np.array(truth)) > 0.85


def test_language_id_odd(odd_docs, no_docs):
    rows = langid.language_id(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].detected is None and by[i].spans == [] and not by[i].keep for i in (3, 4, 6, 8))
    assert sum(s.words for s in by[7].spans) == by[7].words >= 30_000
    assert langid.language_id(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in langid.accept(unlabelled).collect()} == {1, 2, None, 5, 7, 9}
    named = odd_docs.selectExpr("cast(doc_id as string) AS doc_id", "text", "lang", "1 AS __text", "2 AS row", "n_chars AS words")
    got = langid.accept(named)
    assert got.columns == named.columns and {r.doc_id for r in got.collect()} == {"1", "2", None, "5", "7", "9"} and {r["__text"] for r in got.collect()} == {1}
    assert langid.accept(no_docs).columns == no_docs.columns and langid.accept(no_docs).count() == 0


def test_one_short_word():
    model = langid.fit(["the cat", "der Hund"], ["en", "de"], epochs=1)
    for text in ("a", "ab", "é", "a b"):
        assert langid.label_texts(model, pa.array([text]))[0].shape == (len(text.split()), 2)


def test_words_end_at_signs():
    data, starts, ends, first = langid.words_of(pa.array(["Ab\u2014cd ef\u00a0gh\u3002ij", None, "\u65e5\u672c caf\u00e9 x\U0001f600y 1a"]))
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["ab", "cd", "ef", "gh", "ij", "\u65e5\u672c", "caf\u00e9", "x", "y", "a"] and first.tolist() == [0, 5, 5, 10]


# --- 9: quality


def test_trees_against_a_walk():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(np.float64)
    model = quality.fit(x[:1500], y[:1500], trees=30)
    p = model.score(x[1500:])
    assert np.mean((p > 0.5) == y[1500:]) > 0.93
    inner = model.feature.shape[1]
    for i in range(0, 500, 50):
        total = model.start
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            at = 0
            while at < inner:
                at = 2 * at + 1 + (x[1500 + i, f[at]] > t[at])
            total += leaf[at - inner]
        assert p[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality(docs, labels.where("doc_id % 5 <> 0")).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    good = np.array([r.quality for r in scored])
    assert np.mean(np.array([r.keep for r in scored]) == good) > max(np.mean(good), 1 - np.mean(good)) - 0.02
    order = np.argsort([r.score or 0 for r in scored])
    ranks = np.empty(len(order))
    ranks[order] = np.arange(len(order))
    auc = (ranks[good == 1].sum() - (good == 1).sum() * ((good == 1).sum() - 1) / 2) / max(1, (good == 1).sum() * (good == 0).sum())
    assert auc > 0.8


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (7, None), (99, 1)], "doc_id bigint, quality int")
    rows = quality.quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all((r.score is None) == (r.doc_id == 3) for r in rows)
    assert quality.quality(no_docs, labels).count() == 0
    assert {r.keep for r in quality.quality(odd_docs, labels.limit(0)).where("doc_id <> 3").collect()} == {True}


# --- 10: SimHash


def test_near_fingerprints_are_exact(spark):
    r = np.random.default_rng(4)
    seeds = r.integers(0, 1 << 63, (60, 2), dtype=np.int64).view(np.uint64)
    points = []
    for i in range(1500):
        p = seeds[i % 60].copy()
        for bit in r.integers(0, 128, r.integers(0, 30)):
            p[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        points.append(p)
    x = np.array(points)
    table = spark.createDataFrame([(i, int(p.view(np.int64)[0]), int(p.view(np.int64)[1])) for i, p in enumerate(points)], "id bigint, a bigint, b bigint")
    got = {(r.left, r.right): r.distance for r in simhash.near_fingerprints(table, 24, 200).collect()}
    want = {}
    for i in range(len(x)):
        d = simhash.distances(x[i + 1 :], x[i])
        want |= {(i, i + 1 + int(j)): int(d[j]) for j in np.flatnonzero(d <= 24)}
    assert got == want and len(want) > 1000
    weights = {i: i % 5 + 1 for i in range(len(x))}
    linked = simhash.near_links(table.withColumn("w", F.col("id") % 5 + 1), 24, 200)
    sums = {r.id: r.n for r in linked.groupBy("id").agg(F.sum("n").alias("n")).collect()}
    brute = Counter()
    for i, j in want:
        brute[i] += weights[j]
        brute[j] += weights[i]
    assert sums == dict(brute)
    stars = {r.node: r.component for r in groups.components(linked.select(F.col("root").alias("left"), F.col("id").alias("right"))).collect()}
    pairs = {r.node: r.component for r in groups.components(spark.createDataFrame(list(want), "left bigint, right bigint")).collect()}
    assert stars == pairs


@pytest.mark.parametrize("shape", ["spread", "ball", "line"])
def test_shard_tree_loses_no_pair(shape):
    r = np.random.default_rng(7)
    x = r.integers(0, 1 << 63, (3000, 2), dtype=np.int64).view(np.uint64)
    if shape != "spread":
        x[:] = x[0]
        for i in range(len(x)):
            for bit in r.integers(0, 128, 14) if shape == "ball" else range(i % 60):
                x[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    tree = simhash.ShardTree(x[:500], len(x), 300)
    own, reach = tree.place(x, 24)
    assert tree.shards >= 8 and np.bincount(own, minlength=tree.shards).max() < len(x) / 2
    for i in range(0, len(x), 7):
        near = simhash.distances(x, x[i]) <= 24
        assert reach[i, own[near]].all() and reach[near, own[i]].all()


def test_near_dedup(spark):
    text = prose("near", 200)
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(text.split()))
    texts = [prose("far", 200), text, near, text, prose("other", 200), "", ""]
    docs = docs_of(spark, texts)
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [0, 1, 4, 5]
    pairs = sorted((r.doc_id, r.near_id) for r in simhash.near_duplicates(docs).collect())
    assert pairs == [(1, 2), (1, 3), (5, 6)]
    assert sorted(map(tuple, simhash.near_groups(docs).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    assert sorted(map(tuple, simhash.near_classes(docs).collect())) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (5, 5, 1), (6, 5, 1)]


def test_near_dedup_odd(odd_docs, no_docs):
    out = simhash.near_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 1, 3, 4, None, 5, 6, 7, 8, 9])
    assert simhash.near_dedup(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0 and simhash.near_classes(no_docs).count() == 0
    named = odd_docs.selectExpr("coalesce(cast(nullif(doc_id, 9) as string), 'nine') AS doc_id", "text", "1 AS out", "2 AS again", "3 AS row")
    assert Counter(r.doc_id for r in simhash.near_dedup(named).collect()) == Counter(["1", "1", "3", "4", "nine", "nine", "5", "6", "7", "8"])


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "left bigint, right bigint")).collect()}
    want = {x: root(x) for x in {x for e in edges if e[0] != e[1] for x in e}}
    assert got == want
