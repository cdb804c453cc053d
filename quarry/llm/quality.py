"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

#: The trees are fitted on so many labelled documents, those with the least hashes of their ids.
SAMPLE = 8000
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
#: Documents whose probability of good quality is at least this are kept.
THRESHOLD = 0.5

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "white", "newline", "stop", "symbol", "beyond_ascii",
    "word_length", "word_spread", "longest_word", "short_words", "long_words", "distinct_words", "top_word", "distinct_pairs",
    "mixed_words", "words_per_line", "distinct_lines", "stops_per_word",
)

_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 0, 1, 2, 3, 4
_CLASS[[*b".,;:!?'\"-()"]], _CLASS[128:] = 5, 7
_LINE = np.zeros(256, dtype=bool)
_LINE[10] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """(n, len(STATISTICS)) numbers, shares between 0 and 1 where not named otherwise; all 0 for a text without bytes."""
    n = len(texts)
    data, bounds = tb.flat(texts)
    size = np.diff(bounds)
    out = np.zeros((n, len(STATISTICS)), dtype=np.float32)
    if not len(data):
        return out
    owner = np.repeat(np.arange(n), size)
    classes = np.bincount(owner * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    per_byte = 1 / np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    out[:, 2:10] = classes * per_byte[:, None]
    starts, ends = tb.words(data, bounds)
    word_owner, length = owner[starts], ends - starts
    words = np.bincount(word_owner, minlength=n)
    per_word = 1 / np.maximum(words, 1)
    mean = np.bincount(word_owner, weights=length, minlength=n) * per_word
    square = np.bincount(word_owner, weights=length**2, minlength=n) * per_word
    longest = np.zeros(n)
    np.maximum.at(longest, word_owner, length)
    out[:, 1], out[:, 10], out[:, 11], out[:, 12] = np.log1p(words), mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(longest)
    out[:, 13] = np.bincount(word_owner, weights=length <= 3, minlength=n) * per_word
    out[:, 14] = np.bincount(word_owner, weights=length >= 15, minlength=n) * per_word
    hashes = tb.hash_spans(data, starts, ends)
    out[:, 15], out[:, 16] = _variety(hashes, word_owner, n)
    inner = word_owner[1:] == word_owner[:-1]
    out[:, 17] = _variety(tb.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[inner], word_owner[1:][inner], n)[0]
    strange = np.concatenate(([0], np.cumsum((_CLASS[data] == 6) | (_CLASS[data] == 2))))
    out[:, 18] = np.bincount(word_owner, weights=strange[ends] > strange[starts], minlength=n) * per_word
    first, last = tb.words(data, bounds, _LINE)
    line_owner = owner[first]
    lines = np.bincount(line_owner, minlength=n)
    out[:, 19] = words / np.maximum(lines, 1)
    out[:, 20] = _variety(tb.hash_spans(data, first, last), line_owner, n)[0]
    out[:, 21] = classes[:, 5] * per_word
    return out


def _variety(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values among a text's, and the share of the most frequent one."""
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    key = np.sort((owner.astype(np.uint64) << np.uint64(51)) | (hashes >> np.uint64(13)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of = (key[new] >> np.uint64(51)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(new, len(key))))
    return np.bincount(of, minlength=n) / total, most / total


@dataclass
class Trees:
    """Complete binary trees in arrays: node i's children are 2 i + 1 and 2 i + 2; ``leaf`` holds the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows go down a tree together, a level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boost on the logistic loss; splits are sought among ``bins`` quantiles a feature by histograms of gradients."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for f in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(base / (1 - base)))
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf, dtype=np.float32), np.zeros((trees, inner + 1))
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            node = at - first
            best = np.full(width, 1e-6)
            for f in range(k):
                if not len(cuts[f]):
                    continue
                cell = node * bins + binned[:, f]
                hist = [np.bincount(cell, weights=w, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, np.ones(n))]
                (gl, hl, nl), (ga, ha, na) = (s[:, :-1] for s in hist), (s[:, -1:] for s in hist)
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(nl < least) | (na - nl < least)] = 0
                gain = gain[:, : len(cuts[f])]
                cut = gain.argmax(axis=1)
                found = gain[np.arange(width), cut]
                better = found > best
                best[better] = found[better]
                feature[t, first : first + width][better] = f
                threshold[t, first : first + width][better] = cuts[f][cut[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        at -= inner
        leaf[t] = -rate * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + ridge)
        total += leaf[t][at]
    return Trees(feature, threshold, leaf, start)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tb.blocks(batch):
            x = statistics(block.column("text"))
            offsets = pa.array(np.arange(len(block) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([block.column("label"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees | None:
    """Fit on at most ``sample`` labelled documents; None without one. The sample, of bounded size, is broadcast."""
    known = labels.select(F.col(doc_id).alias("doc_id"), (F.col(label) > 0).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_statistics_rows, "label int, x array<float>").toArrow()
    if not rows.num_rows:
        return None
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    y = rows.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; sums of floats must not depend on it
    return fit(x[order], y[order])


def _score_rows(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                null = block.column("text").is_null().to_numpy(zero_copy_only=False)
                p = np.round(shared.value.score(statistics(block.column("text"))), 9)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(p, mask=null), pa.array((p >= threshold) & ~null)], ["doc_id", "score", "keep"])

    return run


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Score every document: (doc_id, score, keep), the probability of good quality and whether it reaches ``threshold``.

    The trees are fitted on ``sample`` documents of ``labels``, all statistics on whole
    texts. A null text has a null score and isn't kept; an empty one is scored like
    any other, by statistics of 0. Repeated rows get equal scores; a document labelled
    twice counts as often; null ids are scored too, null labels ignored. Without a
    labelled document scores are null and every text is kept. Extra columns are
    ignored; empty input gives empty output. Scoring shuffles nothing.
    """
    model = train(docs, labels, doc_id, text, label, sample)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return named.select("doc_id", F.lit(None).cast("double").alias("score"), F.col("text").isNotNull().alias("keep"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast(model), threshold), f"doc_id {kind}, score double, keep boolean")
