"""Each operator against a brute force without the bounds it once had."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, prose

import corpus_pipeline
from quarry.llm import fingerprints, queries, simhash


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("hot", [2, 64])
def test_containers_over_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "HOT", hot)
    r = random.Random(5)
    parts = [prose(f"part {i}", 150) for i in range(8)]
    texts = [" ".join([prose(i, 40), *r.sample(parts, r.randrange(5)), prose(-i, 40)]) for i in range(40)]
    texts += [texts[3], texts[3], texts[9], parts[0], parts[1], "", parts[0]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(5, parts[2], "en", "s", 0), (5, texts[7], "en", "s", 0), (None, texts[11], "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    chunks = {x[1]: {bytes(x[1].encode()[a:b]) for a, b in zip(*fingerprints.chunks(np.frombuffer(x[1].encode(), dtype=np.uint8), np.array([0, len(x[1])])), strict=True)} for x in rows}
    held = defaultdict(set)
    for i, t, *_ in rows:
        held[i] |= chunks[t]
    held.pop(None)
    want = []
    for i, t, *_ in rows:
        share = [(sum(map(len, chunks[t] & held[j])), -j) for j in held if j != i]
        most, minus = max(share)
        want.append((i, sum(map(len, chunks[t])), most or None, -minus if most else None))
    got = [(x.doc_id, x.bytes, x.container_bytes, x.container_id) for x in fingerprints.corpus_containment(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_pairs_of_any_length(spark):
    base = prose("lengths", 100)
    texts = [base, " ".join([base] * 3), base + " " + prose("appended", 25), " ".join(base.split()[:85])]
    texts += ["alder birch cedar dogwood elm fir", "alder birch cedar dogwood elm fir elm", prose("other", 100), prose("other", 90), "?!", "?!", "!"]
    prints = simhash.fingerprint(pa.array(texts))[0]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if simhash.distances(prints[i], prints[j]) <= simhash.RADIUS}
    group = list(range(len(texts)))
    for i, j in sorted(want):
        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    got = {r.doc_id: r.group_id for r in simhash.near_groups(docs_of(spark, texts)).collect()}
    assert got == {i: g for i, g in enumerate(group) if group.count(g) > 1}
    assert got[1] == got[2] == 0 and got[5] == 4
    assert (0, 1, 0) in {tuple(r) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}


def test_lines_of_small_sites(spark, tmp_path):
    pages = [(s, i) for s, n in (("two", 2), ("ten", 10), ("many", 120)) for i in range(n)]
    rows = [(k, f"menu\npair {i // 2}\nline {i}", "en", s, 0) for k, (s, i) in enumerate(pages)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = [f"line {i}" if n < 100 else f"pair {i // 2}\nline {i}" for n in (2, 10, 120) for i in range(n)]
    for out in (queries.op7_line_dedup(spark, str(tmp_path)), corpus_pipeline.lines(spark, docs, "")):
        assert [r.text for r in out.orderBy("doc_id").collect()] == want
