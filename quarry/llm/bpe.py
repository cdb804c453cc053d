"""Byte-level BPE encoding and decoding in numpy (operator 6)."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

#: Where the public vocabularies lie; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words of this much text are merged together.
BLOCK = 1 << 20

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_FAR = np.int64(1 << 40)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], dtype=np.uint8)
    table[_WHITE] = _SPACE
    return table


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces that merges don't cross.

    A piece is an English contraction's ending, a run of letters, of numbers or of
    other marks, each with the one blank before it, or white space: all of a run but
    its last character, which goes with what follows if it is a blank.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(chars)
    kind = _classes()[chars]
    head = np.zeros(n + 1, dtype=bool)  # of a text; one more for the end
    head[np.searchsorted(at, bounds)] = True
    change = head.copy()
    change[1:-1] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = chars[:-1] == 32
    blank_before &= ~head[:-1]
    space = kind == _SPACE
    start = change[:-1] & (space | ~blank_before)
    start[:-1] |= space[:-1] & ~space[1:] & ~head[1:-1]  # the last of a run of white space that something follows
    mark = np.flatnonzero((chars == 39) & change[:-1] & ~blank_before)
    mark = mark[(mark + 1 < n)]
    mark = mark[(kind[mark + 1] == _LETTER) & ~head[mark + 1]]
    if len(mark):
        padded = np.concatenate([chars, np.zeros(2, dtype=np.uint32)])
        one, two = padded[mark + 1], padded[mark + 2]
        two[head[np.minimum(mark + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for chosen, size in ((mark[short], 1), (mark[long], 2)):
            start[chosen + 1] = False
            rest = chosen + 1 + size
            rest = rest[rest < n]
            start[rest[~head[rest] & (kind[rest] == _LETTER)]] = True
    starts = at[start]
    return starts, np.append(starts[1:], len(data))


class Vocabulary:
    """Token bytes by id, and the mergeable pairs sorted by key."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[int(k)] for k in self.keys], dtype=np.int64)
        two = self.of_byte[:, None] << 32 | self.of_byte[None, :]
        found = np.minimum(np.searchsorted(self.keys, two), len(self.keys) - 1)
        self.of_bytes = np.where(self.keys[found] == two, self.ranks[found], _FAR).ravel()
        filled = np.flatnonzero(lengths)
        hashes = tb.hash_spans(self.bytes, self.offsets[:-1][filled], self.offsets[1:][filled])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], filled[order]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words data[start:end], end to end, and how many each word has.

        All symbols of all words lie in one array, beside the ranks of the pairs they
        begin. A round takes each word's lowest rank, merges that pair wherever the word
        has it (from the left where it overlaps itself), looks up by binary search the
        pairs that are new, and sets the words without a pair aside.
        """
        sizes = ends - starts
        raw = data[_ranges(starts, sizes)].astype(np.int64)
        symbols = self.of_byte[raw]
        word = np.repeat(np.arange(len(starts)), sizes)
        rank = np.full(len(raw), _FAR)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.of_bytes[raw[inner] << 8 | raw[inner + 1]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), lengths)
            over = least == _FAR
            if over.any():
                done.append((word[over], symbols[over]))
                word, symbols, rank, least = word[~over], symbols[~over], rank[~over], least[~over]
                if not len(symbols):
                    break
            merges = rank == least
            begins = merges.copy()
            begins[1:] &= ~merges[:-1]  # a word's last symbol never merges, so runs end with their words
            place = np.arange(len(merges))
            since = np.maximum.accumulate(np.where(begins, place, 0))
            merges &= (place - since) % 2 == 0
            symbols = np.where(merges, rank, symbols)
            keep = np.ones(len(symbols), dtype=bool)
            keep[np.flatnonzero(merges) + 1] = False
            symbols, word, rank, merges = symbols[keep], word[keep], rank[keep], merges[keep]
            merges[:-1] |= merges[1:]
            at = np.flatnonzero(merges)
            rank[at] = self._ranks(symbols, word, at)
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
        word, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(word, minlength=len(starts))

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these symbols; far for those that no merge has or that end their word."""
        out = np.full(len(at), _FAR)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        key = symbols[at[inner]] << 32 | symbols[at[inner] + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[inner] = np.where(self.keys[found] == key, self.ranks[found], _FAR)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts end to end, and the n + 1 offsets of the texts."""
        data, bounds = tb.flat(texts)
        starts, ends = pieces(data, bounds)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        hashes, which, inverse = np.unique(tb.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        counts = np.ones(len(hashes), dtype=np.int64)
        whole = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[whole] == hashes
        rest = np.flatnonzero(~known)
        merged, lengths = self.merge(data, starts[which[rest]], ends[which[rest]])
        counts[rest] = lengths
        offsets = np.concatenate(([0], np.cumsum(counts)))
        tokens = np.empty(offsets[-1], dtype=np.int32)
        tokens[offsets[:-1][known]] = self.ids[whole[known]]
        tokens[_ranges(offsets[:-1][rest], counts[rest])] = merged
        sizes = counts[inverse]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return tokens[_ranges(offsets[inverse], sizes)], at[np.searchsorted(starts, bounds)]

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end, and their n + 1 offsets; ids outside the vocabulary raise IndexError."""
        if len(tokens) and (tokens.min() < 0 or tokens.max() >= self.size):
            raise IndexError("a token outside the vocabulary")
        sizes = self.offsets[tokens + 1] - self.offsets[tokens]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return self.bytes[_ranges(self.offsets[tokens], sizes)], at[offsets]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


def _encode_rows(shared, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for block in tb.blocks(batch, limit=block_bytes):
                texts = block.column("text")
                tokens, offsets = vocabulary.encode(texts)
                data, bounds = tb.flat(texts)
                back, ends = vocabulary.decode(tokens, offsets)
                if np.array_equal(back, data) and np.array_equal(ends, bounds):
                    same = np.ones(len(texts), dtype=bool)
                else:
                    same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], bounds[:-1], bounds[1:], strict=True)])
                null = texts.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens), mask=pa.array(null) if null.any() else None)
                yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(np.diff(offsets), mask=null), lists, pa.array(same, mask=null)], ["row", "n_tokens", "tokens", "round_trip"])

    return run


def bpe_encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, block_bytes: int = BLOCK) -> DataFrame:
    """Encode whole texts: the columns ``keep`` and n_tokens BIGINT, tokens ARRAY<INT>, round_trip BOOLEAN.

    Tokens are those of byte-level BPE with the ranks in the file ``vocabulary``
    (lines of base64 token and rank). ``round_trip`` says whether decoding them gave
    the text's bytes again. A null text gives nulls, an empty one no tokens; rows
    are independent of one another, so repeated ones and any order are fine; other
    columns are ignored, and of ``keep`` those named like an output are replaced by
    it. Empty input gives empty output. Nothing is shuffled; the ranks, whose size is
    that of the vocabulary, are broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))
    keep = tuple(c for c in keep if c not in ("n_tokens", "tokens", "round_trip"))
    named = docs.select(_row(keep), F.col(text).alias("text"))
    schema = named.select("row").schema.add("n_tokens", T.LongType()).add("tokens", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType())
    return named.mapInArrow(_encode_rows(shared, block_bytes), schema).select(*[f"row.`{c}`" for c in keep], "n_tokens", "tokens", "round_trip")


def _row(keep: tuple[str, ...]):
    return (F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))).alias("row")


def bpe_decode(encoded: DataFrame, tokens: str = "tokens", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the text of the tokens; of ``keep`` one named text is replaced by it.

    Null tokens give a null text, none an empty one, and bytes that aren't UTF-8 become
    U+FFFD; a token outside the vocabulary, or a null one, raises. Rows are
    independent of one another; other columns of any name are ignored; empty input gives empty output.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))
    keep = tuple(c for c in keep if c != "text")
    named = encoded.select(_row(keep), F.col(tokens).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            data, at = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))))
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return named.mapInArrow(run, named.select("row").schema.add("text", T.StringType())).select(*[f"row.`{c}`" for c in keep], "text")
