"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves whole pre-tokens; a pre-token that is not in
the vocabulary is merged with a heap over its linked bytes, lowest rank first and leftmost on
ties. The vocabulary is given as ranks and its size is fixed, so its tables (about 1 MB) are
broadcast; documents are mapped where they lie, without a shuffle.

Defined results: a null text counts as empty and has no ids; ids decode to the text's exact
UTF-8 bytes; null ids decode to null; repeated rows stay repeated; further columns pass through
unless a result column has their name in any case; whole texts are encoded, however long, a
pre-token of n bytes in n log n steps; pairs of one rank are merged from the left, so ties have one
result; an empty table gives no rows. An id outside the vocabulary raises ValueError.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush, heapreplace
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import bounded_batches, map_batches, table

MEMO_ENTRIES, MEMO_CHARS = 150_000, 48  #: bounds of each of the two generations of pre-tokens a task remembers
_GOLDEN, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class TokenHash:
    """A minimal perfect hash, by hash and displace: n keys fill n slots; a probe compares one key."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = len(keys)
        self.n_buckets = max(1, n // 3)
        hashes = np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, n)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys share a hash or occur twice")
        bucket = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        shifts = np.zeros(self.n_buckets, np.int64)
        slot_of = np.full(n, -1, np.int64)
        used = np.zeros(n, bool)
        by_size = np.argsort(-np.diff(starts), kind="stable")
        for b in by_size:
            own = order[starts[b] : starts[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                tried = np.arange(base, base + 256, dtype=np.uint64)
                slots = self._slots(hashes[own][None, :], tried[:, None], n)
                ordered = np.sort(slots, axis=1)
                good = ~used[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    shifts[b], slot_of[own], used[slots[k]] = base + k, slots[k], True
                    break
                base += 256
        free = iter(np.flatnonzero(~used))
        for b in by_size:  # a bucket of one key names its slot itself
            own = order[starts[b] : starts[b + 1]]
            if len(own) == 1:
                slot_of[own] = s = next(free)
                shifts[b] = -1 - s
        self.n, self.shifts = n, shifts.tolist()
        self.keys: list[bytes] = [b""] * n
        self.ranks = [0] * n
        for key, s in zip(keys, slot_of.tolist(), strict=True):
            self.keys[s], self.ranks[s] = key, ranks[key]

    @staticmethod
    def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hashes ^ (shift * np.uint64(_GOLDEN))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    def get(self, key: bytes) -> int | None:
        h = xxh3_64_intdigest(key)
        shift = self.shifts[h % self.n_buckets]
        slot = -1 - shift if shift < 0 else ((((h ^ (shift * _GOLDEN & _MASK)) * 0xBF58476D1CE4E5B9) & _MASK) >> 32) % self.n
        return self.ranks[slot] if self.keys[slot] == key else None


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each token by the ids of the two tokens that it can be merged from."""
    return {
        left << 32 | right: rank
        for token, rank in ranks.items()
        for k in range(1, len(token))
        if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None
    }


def merge(ids: list[int], rank_of: Callable[[int], int | None], now: list[int | None] | None = None) -> list[int]:
    """Merge the linked parts `ids`, at first one id a byte, by a heap: lowest rank and then leftmost first. now: the ranks of neighbours, if known."""
    n = len(ids)
    if now is None:
        now = [rank_of(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]  # rank of a part and the next; None: no token
    heap = [r * n + i for i, r in enumerate(now) if r is not None]
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    now.append(None)
    while heap:
        r, i = divmod(heap[0], n)
        if now[i] != r:
            heappop(heap)
            continue  # one of the two parts has gone into another
        j = after[i]
        k = after[i] = after[j]
        ids[i], ids[j], now[j] = r, -1, None
        before[k] = i
        now[i] = c = rank_of(r << 32 | ids[k]) if k < n else None
        if c is not None:
            heapreplace(heap, c * n + i)
        if i:
            h = before[i]
            now[h] = d = rank_of(ids[h] << 32 | r)
            if d is not None:
                if c is None:
                    heapreplace(heap, d * n + h)
                else:
                    heappush(heap, d * n + h)
                continue
        if c is None:
            heappop(heap)
    return [x for x in ids if x >= 0]


#: A word with the blank before it, or blanks, of which the last is left to the word that follows.
#: No match of a pattern may go from a non-blank on to a blank: then words can be split and remembered
#: one by one. The class is Unicode's White_Space (fixed values).
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


class Encoder:
    """Encodes texts; remembers the ids of words and pre-tokens it has met, as bytes of 32-bit integers."""

    def __init__(self, whole: TokenHash, pairs: dict[int, int], pattern: str):
        self.whole, self.pair_rank, self.split = whole, pairs.get, regex.compile(pattern).findall
        self.byte_ids = [whole.get(bytes([i])) for i in range(256)]
        rank = lambda a, b: None if a is None or b is None else pairs.get(a << 32 | b)
        self.byte_pairs = [[rank(a, b) for b in self.byte_ids] for a in self.byte_ids]  # ranks by two bytes
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= MEMO_CHARS:
            if len(self.new) >= MEMO_ENTRIES:  # what was not met since the last change is forgotten
                self.old, self.new = self.new, {}
            self.new[piece] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.whole.get(raw)
        if rank is not None:
            return array("i", [rank]).tobytes()
        pairs, ids = self.byte_pairs, self.byte_ids
        return array("i", merge([ids[b] for b in raw], self.pair_rank, [pairs[a][b] for a, b in zip(raw, raw[1:], strict=False)])).tobytes()

    def word(self, word: str) -> bytes:
        if (ids := self.new.get(word) or self.old.get(word)) is not None:
            return self.keep(word, ids)
        pieces = self.split(word)
        if len(pieces) == 1:
            return self.keep(word, self.piece(word))
        return self.keep(word, b"".join([self.new.get(p) or self.keep(p, self.old.get(p) or self.piece(p)) for p in pieces]))

    def encode(self, text: str) -> np.ndarray:
        words = WORDS.findall(text)
        ids = list(map(self.new.get, words))
        if None in ids:
            ids = [self.word(w) if x is None else x for w, x in zip(words, ids, strict=True)]
        return np.frombuffer(b"".join(ids), np.int32)


@lru_cache(maxsize=4)
def tables(path: str) -> tuple[TokenHash, dict[int, int]]:
    ranks = load_ranks(path)
    return TokenHash(ranks), pair_ranks(ranks)


class Decoder:
    def __init__(self, whole: TokenHash):
        self.tokens = np.full(max(whole.ranks) + 1, None, object)
        self.tokens[whole.ranks] = whole.keys

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError(f"ids {ids.min()} to {ids.max()}: not all are in the vocabulary")
        return b"".join(self.tokens[ids])


def _mapped(df: DataFrame, vocabulary: str, column: str, added: list[T.StructField], make: Callable) -> DataFrame:
    """df with further columns, from make(encoder and decoder tables)(values of column) -> arrays."""
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(tables(vocabulary))
    own = {f.name.lower() for f in added}
    schema = T.StructType([f for f in df.schema.fields if f.name.lower() not in own] + added)
    passed, at = [df.columns.index(f.name) for f in schema.fields[: len(schema.fields) - len(added)]], df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), *of(batch.column(at))], names=schema.names)

    return map_batches(df, run, schema)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=pa.list_(pa.field("element", pa.int32(), nullable=False)))


_IDS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add `ids`, the token ids of the column `text`. vocabulary: path of the ranks on the driver."""

    def make(whole, pairs):
        encoder = Encoder(whole, pairs, pattern)
        return lambda texts: [_lists([encoder.encode(x or "") for x in texts.to_pylist()])]

    return _mapped(df, vocabulary, text, [T.StructField(ids, _IDS)], make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add `decoded`, the bytes that the column `ids` stands for."""

    def make(whole, pairs):
        decoder = Decoder(whole)

        def of(lists: pa.Array) -> list[pa.Array]:
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            told = lists.is_valid().to_pylist()
            return [pa.array([decoder.decode(flat[a:b]) if ok else None for a, b, ok in zip(offsets, offsets[1:], told, strict=False)], pa.binary())]

        return of

    return _mapped(df, vocabulary, ids, [T.StructField(decoded, T.BinaryType())], make)


def encode_and_decode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode and then decode of its ids, by one Python process a task instead of two."""

    def make(whole, pairs):
        encoder, decoder = Encoder(whole, pairs, pattern), Decoder(whole)

        def of(texts: pa.Array) -> list[pa.Array]:
            rows = [encoder.encode(x or "") for x in texts.to_pylist()]
            return [_lists(rows), pa.array([decoder.decode(x) for x in rows], pa.binary())]

        return of

    return _mapped(df, vocabulary, text, [T.StructField(ids, _IDS), T.StructField(decoded, T.BinaryType())], make)


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text)."""
    read = encode_and_decode(docs.select("doc_id", "text"), vocabulary, pattern).drop("text")
    return read.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def production() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the registered query and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *production())
