"""The pipeline against a plain loop over all documents, and each stage on odd rows."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, prose

import corpus_pipeline
from quarry.llm import bpe, langid, line_dedup, mixing, simhash


def posteriors(model, text):
    """Mean posterior of each language over a text's words, by forward-backward a word at a time; None without a word."""
    data, starts, ends, _ = langid.words_of(pa.array([text], pa.string()))
    if not len(starts):
        return None
    scores = np.array([model.emissions(data, starts[i : i + 1], ends[i : i + 1], langid.tb.hash_spans(data, starts[i : i + 1], ends[i : i + 1]))[0] for i in range(len(starts))], dtype=np.float64)
    step, k = np.exp(model.transitions), scores.shape[1]
    ahead, back = [], [np.ones(k)]
    v = np.full(k, 1 / k)
    for s in scores:
        v = (v @ step) * np.exp(s - s.max())
        v /= v.sum()
        ahead.append(v)
    for s in scores[:0:-1]:
        w = step @ (np.exp(s - s.max()) * back[-1])
        back.append(w / w.sum())
    both = np.array(ahead) * np.array(back[::-1])
    return (both / both.sum(axis=1, keepdims=True)).mean(axis=0)


def brute_language(rows, model):
    return [r for r in rows if r["text"] is not None and (p := posteriors(model, r["text"])) is not None and p.max() >= langid.MIN_SHARE]


def brute_lines(rows):
    pages, seen = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        if r["source"] is not None and r["text"] is not None:
            seen.update({(r["source"], line.strip(" ")) for line in r["text"].split("\n") if line.strip(" ")})
    bad = {key for key, n in seen.items() if n >= 2 and n > line_dedup.RATIO * pages[key[0]]}
    out = []
    for r in rows:
        text = r["text"]
        if text is not None and r["source"] is not None:
            text = "\n".join(line for line in text.split("\n") if (r["source"], line.strip(" ")) not in bad)
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def brute_near(rows):
    named = [r for r in rows if r["doc_id"] is not None and r["text"] is not None]
    prints, _ = simhash.fingerprint(pa.array([r["text"] for r in named], pa.string()))
    group = {r["doc_id"]: r["doc_id"] for r in named}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, r in enumerate(named):
        for j in np.flatnonzero(simhash.distances(prints[:i], prints[i]) <= simhash.RADIUS):
            a, b = sorted((root(named[j]["doc_id"]), root(r["doc_id"])))
            group[b] = a
    out, had = [r for r in rows if r["doc_id"] is None or r["text"] is None], set()
    for r in named:
        if root(r["doc_id"]) == r["doc_id"] and (r["doc_id"], r["text"]) not in had:
            had.add((r["doc_id"], r["text"]))
            out.append(r)
    return out


def brute_mix(rows):
    of = defaultdict(list)
    for r in rows:
        n = len(re.findall(r"[^ \t\n\r\f]+", r["text"] or ""))
        key = int(hashlib.md5(f"{mixing.SEED}:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:15], 16)
        of[r["source"]].append((key, n, r))
    total = {s: sum(n for _, n, _ in x) for s, x in of.items()}
    total = {s: n for s, n in total.items() if n}
    weight = sum(n**mixing.TEMPERATURE for n in total.values())
    out = []
    for s, n in total.items():
        share = math.floor(round(sum(total.values()) * n**mixing.TEMPERATURE / weight, 3))
        start = 0
        for _, tokens, r in sorted(of[s], key=lambda x: x[0]):
            out += [r] * (share // n + (start < share % n))
            start += tokens
    return out


def encoder():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_run_against_a_loop(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = docs.first().text
    odd = [(9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "?! 12", None, "src1", 5), (9004, prose(4, 30), "en", None, 1), (9005, whole, "en", "src2", 1), (9006, whole + " more", "en", "src3", 1), (None, prose(7, 50), "en", "src1", 9), (9004, prose(4, 30), "en", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, DOCS).select(docs.columns))
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.source, tuple(r.tokens), r.n_tokens, r.round_trip) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    rows = brute_language([r.asDict() for r in docs.collect()], langid.train(docs))
    assert 9003 not in {r["doc_id"] for r in rows} and len(rows) > 150
    rows = brute_mix(brute_near(brute_lines(rows)))
    encode = encoder().encode_ordinary
    want = [(r["doc_id"], r["source"], tuple(t := encode(r["text"])), len(t), True) for r in rows]
    assert Counter(got) == Counter(want) and 100 < len({w[0] for w in want}) < docs.count()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd_docs, no_docs, stage):
    names = ["doc_id", "lang", "source", "n_tokens", "tokens", "round_trip"]
    for docs in (odd_docs, odd_docs.selectExpr("*", "1 AS __text", "2 AS row", "3 AS rep", "4 AS `t`"), odd_docs.selectExpr("cast(doc_id as string) AS doc_id", "text", "lang", "source", "n_chars")):
        out = stage(spark, docs, "")
        assert out.columns == (names if stage is corpus_pipeline.encode else docs.columns)
        assert out.count() > 0
    assert stage(spark, no_docs, "").count() == 0
    if stage not in (corpus_pipeline.encode, corpus_pipeline.mixture):
        kept = {r.doc_id for r in stage(spark, odd_docs, "").collect()}
        assert {1, 5, 7, None} <= kept
