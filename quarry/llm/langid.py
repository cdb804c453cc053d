"""Language ID of words with a linear-chain conditional random field (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

#: The model is fitted on so many labelled documents, those with the least hashes of their ids.
SAMPLE = 400
#: A document is accepted if one language has at least this share of its words.
MIN_SHARE = 0.4
#: Words of a language's lexicon: its most frequent ones in the sample.
LEXICON = 3000

_SPACE_BITS = 17
_GRAMS = (2, 3, 4, 5)
_CHUNK = 64
_WORDS = 16384
_APART = np.ones(256, dtype=bool)
_APART[[*b"abcdefghijklmnopqrstuvwxyz"]] = False
_APART[128:] = False
#: First bytes, and how many in all, of characters beyond ASCII that aren't letters: U+0080-00BF, U+2000-2FFF, U+3000-303F, and those beyond U+1F000.
_MARKS = ((b"\xc2", 2), (b"\xe2", 3), (b"\xe3\x80", 3), (b"\xf0\x9f", 4))
_EDGE = 0  # a byte that no word has, before and after each word


@dataclass
class Model:
    """``weights`` (features, languages); ``lexicon`` sorted word hashes with ``member`` (words, languages) flags; ``transitions`` (from, to)."""

    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores (words, languages), some words at a time: each has dozens of features."""
        scores = np.empty((len(starts), len(self.langs)), dtype=np.float32)
        for i in range(0, len(starts), _WORDS):
            feature, word = features(data, starts[i : i + _WORDS], ends[i : i + _WORDS])
            n = len(starts[i : i + _WORDS])
            first = np.searchsorted(word, np.arange(n))
            scores[i : i + n] = np.add.reduceat(self.weights[feature], first, axis=0) / np.diff(np.append(first, len(word)))[:, None] ** 0.5
        return scores + self._lexical(hashes)

    def _lexical(self, hashes: np.ndarray) -> np.ndarray:
        return self.in_lexicon(hashes) @ self.lexicon_weights

    def in_lexicon(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.langs)), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == hashes)[:, None]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-case texts, starts and ends of their words, and the words' first index in each text.

    A word is a run of a-z and of characters beyond ASCII, but for signs and punctuation (``_MARKS``).
    """
    data, bounds = tb.flat(pc.utf8_lower(texts))
    if len(data) and data.max() > 127:
        data = data.copy()
        for first, size in _MARKS:
            at = np.flatnonzero(data == first[0])
            for i, byte in enumerate(first[1:], 1):
                at = at[data[at + i] == byte]
            for i in range(size):
                data[at + i] = 32
    starts, ends = tb.words(data, bounds, _APART)
    return data, starts, ends, np.searchsorted(starts, bounds)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, sorted by word: n-grams of its bytes and edges, so that those with an edge are its affixes."""
    sizes = ends - starts + 2
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    framed = np.full(offsets[-1], _EDGE, dtype=np.uint64)
    inner = np.ones(offsets[-1], dtype=bool)
    inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
    spans = np.repeat(starts - (offsets[:-1] + 1), sizes - 2) + np.flatnonzero(inner)
    framed[inner] = data[spans]
    word = np.repeat(np.arange(len(starts)), sizes)
    found, owner = [], []
    code = framed
    for n in range(2, min(max(_GRAMS), len(framed)) + 1):
        code = (code[:-1] << np.uint64(8)) | framed[n - 1 :]
        inside = word[n - 1 :] == word[: len(word) - n + 1]
        found.append(tb.mix(code[inside] * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - _SPACE_BITS))
        owner.append(word[: len(word) - n + 1][inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), owner[order]


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior label probabilities (words, languages) by forward-backward over each text's words.

    Before a text's first word stands a word of unknown language, each as likely.

    Texts are cut into chunks of a fixed number of words. Each chunk's transfer
    matrix is formed for all chunks at once, the matrices are chained along each
    text for the messages at the chunks' borders, and the messages within run for all
    chunks at once again: exact, with loops as long as a chunk and as the number of
    chunks of the longest text.
    """
    n, k = scores.shape
    if not n:
        return scores
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    sizes = np.diff(first)
    full = np.flatnonzero(sizes > 0)
    per_text = -(-sizes[full] // _CHUNK)
    text_chunk = np.concatenate(([0], np.cumsum(per_text)))
    ordinal = np.arange(text_chunk[-1]) - np.repeat(text_chunk[:-1], per_text)
    begin = np.repeat(first[:-1][full], per_text) + ordinal * _CHUNK
    length = np.minimum(np.repeat(first[1:][full], per_text) - begin, _CHUNK)
    by_size = np.argsort(-length, kind="stable")  # at step t the chunks that still have words are the first ones
    begin, length = begin[by_size], length[by_size]
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(_CHUNK)]
    transfer = np.broadcast_to(np.eye(k), (len(begin), k, k)).copy()
    for t in range(_CHUNK):
        m = alive[t]
        if not m:
            break
        part = (transfer[:m].reshape(-1, k) @ step).reshape(m, k, k) * emit[begin[:m] + t][:, None, :]
        transfer[:m] = part / part.sum(axis=(1, 2), keepdims=True)
    in_order = np.empty_like(transfer)
    in_order[by_size] = transfer
    ahead, behind = np.full((len(begin), k), 1 / k), np.full((len(begin), k), 1 / k)
    longest = np.argsort(-per_text, kind="stable")
    heads, counts = text_chunk[:-1][longest], per_text[longest]
    for c in range(1, int(counts.max())):
        at = heads[: int(np.searchsorted(-counts, -c, side="left"))] + c
        v = np.matmul(ahead[at - 1][:, None, :], in_order[at - 1])[:, 0]
        ahead[at] = v / v.sum(axis=1, keepdims=True)
    tails = text_chunk[1:][longest] - 1
    for c in range(1, int(counts.max())):
        at = tails[: int(np.searchsorted(-counts, -c, side="left"))] - c
        v = np.matmul(in_order[at + 1], behind[at + 1][:, :, None])[:, :, 0]
        behind[at] = v / v.sum(axis=1, keepdims=True)
    forward, backward = np.empty((n, k)), np.empty((n, k))
    v = ahead[by_size]
    for t in range(_CHUNK):
        m = alive[t]
        if not m:
            break
        at = begin[:m] + t
        w = (v[:m] @ step) * emit[at]
        v[:m] = w / w.sum(axis=1, keepdims=True)
        forward[at] = v[:m]
    v = behind[by_size]
    for t in range(_CHUNK - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        backward[at] = v[:m]
        w = (emit[at] * v[:m]) @ step.T
        v[:m] = w / w.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 5, epochs: int = 3, window: int = 48, batch: int = 48, rate: float = 0.25, decay: float = 1e-6) -> Model | None:
    """Fit the field on texts of one language each; None without any word.

    Half of the training sequences are windows of the texts, half are code-switched:
    runs of 2 to 12 words from windows of different texts in turn, which is what
    the transitions are learned from. Maximum likelihood by AdaGrad, with gradients from
    forward-backward.
    """
    random = np.random.default_rng(seed)
    langs = sorted(set(labels))
    data, starts, ends, first = words_of(pa.array(texts, pa.large_string()))
    if not len(starts):
        return None
    hashes = tb.hash_spans(data, starts, ends)
    label_of_text = np.array([langs.index(x) for x in labels])
    label = np.repeat(label_of_text, np.diff(first))
    kinds, which, kind = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.zeros((len(kinds), len(langs)))
    np.add.at(counts, (kind, label), 1)
    member = np.zeros((len(kinds), len(langs)), dtype=np.float32)
    for i in range(len(langs)):
        # known from two texts' worth of use at least: a word seen once would only teach the model its own sample
        top = np.argsort(-counts[:, i], kind="stable")[:LEXICON]
        member[top[counts[top, i] >= 3], i] = 1
    used = member.any(axis=1)
    model = Model(langs, np.zeros((1 << _SPACE_BITS, len(langs)), dtype=np.float32), kinds[used], member[used], np.zeros((len(langs), len(langs)), dtype=np.float32), np.zeros((len(langs), len(langs))))
    feature, owner = features(data, starts[which], ends[which])
    feature_first = np.concatenate((np.searchsorted(owner, np.arange(len(kinds))), [len(owner)]))
    scale = np.diff(feature_first) ** -0.5

    sequences = [np.arange(a, min(a + window, e)) for s, e in zip(first[:-1], first[1:], strict=True) for a in range(s, e, window)]
    mixed = []
    order = random.permutation(len(sequences))
    for i in range(0, len(order), 4):
        parts, cursor = [sequences[j] for j in order[i : i + 4]], [0] * 4
        out, turn = [], 0
        while len(out) < len(parts) * window and any(c < len(p) for c, p in zip(cursor, parts, strict=False)):
            run = int(random.integers(2, 13))
            out += parts[turn][cursor[turn] : cursor[turn] + run].tolist()
            cursor[turn] += run
            turn = (turn + 1) % len(parts)
        mixed += [np.array(out[a : a + window]) for a in range(0, len(out), window)]
    sequences += mixed
    grown = [np.full_like(x, 1e-4, dtype=np.float64) for x in (model.weights, model.lexicon_weights, model.transitions)]
    for epoch in range(epochs):
        order = random.permutation(len(sequences))
        for i in range(0, len(order), batch):
            chosen = [sequences[j] for j in order[i : i + batch]]
            at = np.concatenate(chosen)
            sizes = np.array([len(c) for c in chosen])
            here = np.concatenate(([0], np.cumsum(sizes)))
            local, back = np.unique(kind[at], return_inverse=True)
            spans = np.concatenate([np.arange(feature_first[w], feature_first[w + 1]) for w in local])
            feats = feature[spans]
            rows = np.repeat(np.arange(len(local)), feature_first[local + 1] - feature_first[local])
            offsets = np.concatenate(([0], np.cumsum(feature_first[local + 1] - feature_first[local])))[:-1]
            inside = model.in_lexicon(kinds[local])
            per_kind = np.add.reduceat(model.weights[feats], offsets, axis=0) * scale[local][:, None] + inside @ model.lexicon_weights
            scores = per_kind[back].astype(np.float64)
            gamma, pairs = _expectations(scores, here, model.transitions)
            wrong = gamma
            wrong[np.arange(len(at)), label[at]] -= 1
            follows = np.ones(len(at), dtype=bool)
            follows[here[:-1]] = False
            seen = np.zeros_like(model.transitions)
            np.add.at(seen, (label[at[:-1]][follows[1:]], label[at[1:]][follows[1:]]), 1)
            per_kind_wrong = np.zeros((len(local), len(langs)))
            np.add.at(per_kind_wrong, back, wrong)
            slope = per_kind_wrong[rows] * scale[local][rows][:, None]
            touched, inverse = np.unique(feats, return_inverse=True)
            g = np.stack([np.bincount(inverse, weights=slope[:, c], minlength=len(touched)) for c in range(len(langs))], axis=1) + decay * model.weights[touched]
            grown[0][touched] += g**2
            model.weights[touched] -= (rate * g / np.sqrt(grown[0][touched])).astype(np.float32)
            for k, grad, value in ((1, inside.T @ per_kind_wrong, model.lexicon_weights), (2, pairs - seen, model.transitions)):
                grad = grad + decay * value
                grown[k] += grad**2
                value -= (rate * grad / np.sqrt(grown[k])).astype(value.dtype)
    return model


def _expectations(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and expected numbers of each transition, of short sequences."""
    k = scores.shape[1]
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes.max()))]
    forward, backward = np.empty_like(emit), np.empty_like(emit)
    v = np.full((len(begin), k), 1 / k)
    for t, m in enumerate(alive):
        w = (v[:m] @ step) * emit[begin[:m] + t]
        v[:m] = w / w.sum(axis=1, keepdims=True)
        forward[begin[:m] + t] = v[:m]
    v = np.full((len(begin), k), 1 / k)
    pairs = np.zeros((k, k))
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        at = begin[:m] + t
        backward[at] = v[:m]
        w = emit[at] * v[:m]
        if t:
            joint = forward[at - 1][:, :, None] * step[None] * w[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        w = w @ step.T
        v[:m] = w / w.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), pairs


def label_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (words, languages) of all texts' words, the texts' first words, and the words' labels."""
    data, starts, ends, first = words_of(texts)
    if not len(starts):
        return np.zeros((0, len(model.langs))), first, np.zeros(0, dtype=np.int64)
    hashes = tb.hash_spans(data, starts, ends)
    kinds, which, kind = np.unique(hashes, return_index=True, return_inverse=True)
    gamma = marginals(model.emissions(data, starts[which], ends[which], kinds)[kind].astype(np.float64), first, model.transitions)
    return gamma, first, gamma.argmax(axis=1)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents; None if there is no labelled word.

    The keys of the sample are chosen first, so that tasks send the driver keys
    rather than texts; then only the chosen texts travel.
    """
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("key")).where("lang IS NOT NULL AND text IS NOT NULL")
    last = known.select("key").orderBy("key").limit(sample).agg(F.max("key")).first()[0]
    if last is None:
        return None
    rows = known.where(F.col("key") <= last).orderBy("key", "lang", "text").limit(sample).collect()
    return fit([r.text for r in rows], [r.lang for r in rows])


_SPANS = pa.list_(pa.struct([("words", pa.int32()), ("lang", pa.string())]))
_SCHEMA = "words bigint, detected string, share double, keep boolean, spans array<struct<words: int, lang: string>>"


def _label_rows(shared, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for block in tb.blocks(batch):
                n = len(block)
                gamma, first, label = label_texts(model, block.column("text"))
                sizes = np.diff(first)
                some = sizes > 0
                share, best = np.zeros(n), np.zeros(n, dtype=np.int64)
                if some.any():
                    mass = np.add.reduceat(gamma, first[:-1][some], axis=0) / sizes[some][:, None]
                    best[some], share[some] = mass.argmax(axis=1), mass.max(axis=1)
                turn = np.ones(len(label), dtype=bool)
                turn[1:] = label[1:] != label[:-1]
                turn[first[:-1][some]] = True
                runs = np.flatnonzero(turn)
                names = pa.array(model.langs)
                spans = pa.StructArray.from_arrays([pa.array(np.diff(np.append(runs, len(label))).astype(np.int32)), names.take(pa.array(label[runs]))], ["words", "lang"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs, first).astype(np.int32)), spans)
                others = [c for c in block.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*[block.column(c) for c in others], pa.array(sizes), names.take(pa.array(best, mask=~some)), pa.array(share, mask=~some), pa.array(some & (share >= min_share)), lists],
                    [*others, "words", "detected", "share", "keep", "spans"],
                )

    return run


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, min_share: float = MIN_SHARE, model: Model | None = None) -> DataFrame:
    """Label the words of every text: (doc_id, words, detected, share, keep, spans).

    Words are runs of letters, lower-cased (:func:`words_of`). ``spans`` is the text's words in order as
    runs of one language; ``share`` is the mean posterior probability of the language
    ``detected``, and a document is kept (``keep``) if it reaches ``min_share``. A text that
    is null, empty or without a letter has no words, null language and share, empty
    spans, and is not kept. Every row is labelled by itself: repeated rows get
    equal results, null ids and labels stay null, extra columns are ignored, empty
    input gives empty output.

    Without ``model`` one is fitted on ``sample`` labelled documents of the table; if
    none has a label and a word, all languages are null and every row with a letter
    is kept, since nothing speaks against it. The model, of fixed size, is broadcast;
    nothing is shuffled.
    """
    spark = docs.sparkSession
    model = model or train(docs, doc_id, text, lang, sample)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return named.select("doc_id", F.lit(0).cast("bigint").alias("words"), F.lit(None).cast("string").alias("detected"), F.lit(None).cast("double").alias("share"), letters.alias("keep"), F.array().cast("array<struct<words: int, lang: string>>").alias("spans"))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(_label_rows(spark.sparkContext.broadcast(model), min_share), f"doc_id {kind}, {_SCHEMA}")


def _accept_rows(shared, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch):
                gamma, first, _ = label_texts(shared.value, block.column("text"))
                sizes = np.diff(first)
                some = sizes > 0
                good = np.zeros(len(block), dtype=bool)
                if some.any():
                    good[some] = (np.add.reduceat(gamma, first[:-1][some], axis=0) / sizes[some][:, None]).max(axis=1) >= min_share
                yield block.filter(pa.array(good)).drop_columns(["text"])

    return run


def accept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that :func:`language_id` keeps, with all their columns, whatever their names and types.

    Rows with a null, an empty or a letterless text go. Null ids and labels don't
    matter, texts of any length count whole, repeated rows stay or go together, and an
    empty table stays empty. Where nothing is labelled, every row with a letter stays.
    """
    model = train(docs, doc_id, text, lang, sample)
    if model is None:
        return docs.where(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(_accept_rows(shared, min_share), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
