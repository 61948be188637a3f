"""Byte-level BPE encoding and decoding.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry is resolved by one
probe and one comparison. Tier two merges the bytes of all other pre-tokens, held as a doubly linked list, in the order
of a heap of (rank, position).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presetlake.llm.common import ship

_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file, in rank order. Only the driver reads the file."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [token for _, token in ranked]


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys fill exactly n slots.

    A key's 64-bit hash picks a bucket; the bucket's displacement, xor-ed into the hash, gives the slot. Buckets of one
    key store their slot directly, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = [xxhash.xxh64_intdigest(k, 7) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in order:
            own = members[b]
            if len(own) < 2:
                break
            seed = 1
            while True:
                places = [self._mix(hashes[i], seed) % n for i in own]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
                seed += 1
            self.shift[b] = seed
            for i, p in zip(own, places):
                self.slots[p] = i
        free = iter([s for s in range(n) if self.slots[s] < 0])
        for b in order:
            if len(members[b]) == 1:
                slot = next(free)
                self.shift[b] = -1 - slot
                self.slots[slot] = members[b][0]

    @staticmethod
    def _mix(h: int, seed: int) -> int:
        h = ((h ^ (seed * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9) & _MASK
        return h ^ (h >> 31)

    def candidate(self, key: bytes) -> int:
        """The only index that ``key`` can have; the caller compares the key stored there."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key, 7)
        seed = self.shift[h % self.buckets]
        return self.slots[-1 - seed] if seed < 0 else self.slots[self._mix(h, seed) % self.n]


class _Memory(dict):
    """Ids of pre-tokens seen lately, in two generations of bounded size; it changes no result."""

    #: Entries of a generation, and the longest pre-token that is remembered.
    ENTRIES, LONGEST = 500_000, 64

    def __init__(self, resolve):
        super().__init__()
        self.resolve, self.old = resolve, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece) or self.resolve(piece.encode())
        if len(piece) <= self.LONGEST:
            if len(self) >= self.ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes text to ids and ids to bytes. ``tokens`` are in rank order; ``pattern`` splits text into pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str, index: PerfectHash | None = None):
        self.tokens, self.hash = tokens, index or PerfectHash(tokens)
        self.split = regex.compile(pattern).findall
        self.pairs = {t: i for i, t in enumerate(tokens)}
        self.two = {(t[0], t[1]): i for i, t in enumerate(tokens) if len(t) == 2}.get
        self.decimals = [str(i) for i in range(len(tokens))]
        self.known = _Memory(self.piece)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        at = self.hash.candidate(piece)
        if at >= 0 and self.tokens[at] == piece:
            return (at,)
        return self._merge(piece)

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until no pair is in the vocabulary.

        A heap entry is one integer: the rank, the left part's start, the right part's end, in fields of ``bits`` bits.
        """
        n, rank, two = len(piece), self.pairs.get, self.two
        bits = n.bit_length()
        twice, low = 2 * bits, (1 << bits) - 1
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it has been merged away
        before = list(range(-1, n - 1))
        heap = [r << twice | i << bits | i + 2 for i, pair in enumerate(zip(piece, piece[1:])) if (r := two(pair)) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, stop = top >> bits & low, top & low
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i] = stop
            end[middle] = 0
            if stop < n:
                before[stop] = i
                after = end[stop]
                if (r := rank(piece[i:after])) is not None:
                    heappush(heap, r << twice | i << bits | after)
            if i and (r := rank(piece[(j := before[i]) : stop])) is not None:
                heappush(heap, r << twice | j << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.pairs[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    name, tokens, index = shared.value
    if (name, pattern) not in _codecs:
        _codecs.clear()
        _codecs[name, pattern] = Codec(tokens, pattern, index)
    return _codecs[name, pattern]


def _broadcast(df: DataFrame, vocabulary: str):
    """The tokens and their perfect hash for all executors; the vocabulary file, not the data, fixes their size."""
    ship(df.sparkSession)
    tokens = read_ranks(vocabulary)
    name = hashlib.sha256(b"\n".join(tokens)).hexdigest()
    return df.sparkSession.sparkContext.broadcast((name, tokens, PerfectHash(tokens)))


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``, an array of token ids; a null text counts as empty. A column of that name is replaced."""
    shared = _broadcast(df, vocabulary)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared, pattern)
        for texts in batches:
            yield pd.Series([np.array(codec.encode(t or ""), np.int32) for t in texts])

    return df.withColumn(ids_col, run(F.col(text_col)))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col``, the bytes of the ids; null ids, and lists that hold a null or an id that no token has, give null.

    A column of that name is replaced.
    """
    shared = _broadcast(df, vocabulary)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        table = dict(enumerate(shared.value[1]))

        def one(ids) -> bytes | None:
            parts = None if ids is None else [table.get(i) for i in np.asarray(ids).tolist()]
            return None if parts is None or None in parts else b"".join(parts)

        return pd.Series([one(ids) for ids in column])

    return df.withColumn(bytes_col, run(F.col(ids_col)))


def digests(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text; return ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One Arrow pass without a shuffle: the ids stay in the Python worker. Null and empty texts have no tokens and the
    digests of nothing; repeated rows and null ids each give their own row; other columns are left out.
    """
    shared = _broadcast(df, vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared, pattern)
        decimal = codec.decimals.__getitem__
        for texts in batches:
            rows = []
            for text in texts:
                ids = codec.encode(text or "")
                rows.append((len(ids), hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("d")).select("doc_id", "d.*")
