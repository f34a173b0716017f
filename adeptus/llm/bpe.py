"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern and every match is encoded by
itself, in two tiers:

1. a minimal perfect hash over the vocabulary finds the matches that are
   whole vocabulary entries (hashed for many matches at once, then compared
   byte by byte, so a false hit is impossible);
2. each other match is merged by adjacent pairs, lowest rank first, leftmost
   first among equals: short ones many at a time, one pair of each in a round,
   by a sorted table of all pairs of entries that are an entry together; a long
   one with a heap of pairs over a linked list of its bytes, in O(n log n)
   however long it is.

Results per distinct match are remembered in a bounded two-generation memo.

``encode`` yields ids packed as little-endian unsigned 32-bit integers,
``decode`` the bytes of packed ids.  A null text is an empty text: no ids,
empty bytes.  Null ids are passed on as null keys; repeated rows are encoded
each; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adeptus.llm.shared import by_batches
from adeptus.llm.textblock import BYTE_KEY, column_bytes, mix, powers, slices

#: Bytes of one generation of the memo; characters from which a match is not kept.
MEMO_BYTES, LONG = 16 << 20, 64
#: Bytes of text tokenised at once.
SLICE_BYTES = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank, from a file of ``base64 rank`` lines."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} aren't 0..{len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def hash_many(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each non-empty byte string."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    raw = np.frombuffer(b"".join(tokens), np.uint8)
    first = np.cumsum(size) - size
    place = np.arange(len(raw)) - np.repeat(first, size)
    return mix(np.add.reduceat(BYTE_KEY[raw] * powers(int(size.max()))[place], first))


class PerfectHash:
    """Minimal perfect hash by displacement: n keys onto n slots.

    Keys fall into n/4 buckets.  Buckets are placed from the largest to the
    smallest; each stores the first displacement that sends its keys to free
    slots.  Buckets of one key store their slot directly.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = hash_many(keys)
        if len(np.unique(h)) != n:
            raise ValueError("vocabulary entries repeat")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        self.displace = np.zeros(self.buckets, np.int64)
        self.key_at = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        singles = []
        for b in np.argsort(-size, kind="stable"):
            members = order[first[b]:first[b] + size[b]]
            if size[b] == 0:
                break
            if size[b] == 1:
                singles.append((b, members[0]))
                continue
            d, place = 1, None
            while place is None:       # many displacements are tried at once
                tried = np.arange(d, d + 256)
                slots = np.sort(self._slot(h[members][:, None], tried[None, :]), axis=0)
                fits = np.flatnonzero(free[slots].all(axis=0) & (np.diff(slots, axis=0) > 0).all(axis=0))
                if len(fits):
                    d = int(tried[fits[0]])
                    place = self._slot(h[members], np.int64(d))
                else:
                    d += 256
            slot = place
            self.displace[b] = d
            self.key_at[slot] = members
            free[slot] = False
        for (b, key), slot in zip(singles, np.flatnonzero(free)):
            self.displace[b] = -slot - 1
            self.key_at[slot] = key

    def _slot(self, h: np.ndarray, d) -> np.ndarray:
        spread = mix(h + np.asarray(d).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return (spread % np.uint64(self.n)).astype(np.int64)

    def find(self, tokens: list[bytes]) -> np.ndarray:
        """For each token the only key that it can be."""
        h = hash_many(tokens)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(d < 0, -d - 1, self._slot(h, d))]


class Pairs:
    """Pairs of vocabulary entries that are an entry together, and merging of many matches at once."""

    def __init__(self, vocabulary: list[bytes]):
        rank_of = {t: i for i, t in enumerate(vocabulary)}
        keys, merged = [], []
        for rank, token in enumerate(vocabulary):
            for cut in range(1, len(token)):
                left, right = rank_of.get(token[:cut]), rank_of.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.none = len(vocabulary)
        self.merged = np.append(np.array(merged, np.int32)[order], self.none).astype(np.int32)
        self.single = np.array([rank_of.get(bytes([b]), -1) for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's entry; ``none`` where there is no such entry."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], self.none)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """Packed ids of each non-empty match, as :func:`merge` gives them."""
        out: list[bytes] = [b""] * len(tokens)
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        part = self.single[np.frombuffer(b"".join(tokens), np.uint8)]
        if (part < 0).any():
            raise KeyError("the vocabulary lacks a byte")
        which = np.arange(len(tokens))                  # the matches still merged
        rank = np.full(len(part), self.none, np.int64)  # of each part with the next one of its match
        inner = np.ones(len(part), bool)
        inner[np.cumsum(size) - 1] = False
        fresh = np.flatnonzero(inner)
        rank[fresh] = self.rank(part[fresh], part[fresh + 1])
        while len(which):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, first)
            going = low < self.none
            if not going.all():
                stay = np.repeat(going, size)
                packed, end = part[~stay].astype("<u4").tobytes(), 4 * np.cumsum(size[~going])
                for i, a, b in zip(which[~going].tolist(), (end - 4 * size[~going]).tolist(), end.tolist()):
                    out[i] = packed[a:b]
                part, rank, which, size, low = part[stay], rank[stay], which[going], size[going], low[going]
                if not len(which):
                    break
            owner = np.repeat(np.arange(len(which)), size)
            at = np.flatnonzero(rank == low[owner])
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]      # the leftmost of each match
            part[at] = rank[at]
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            part, rank, owner = part[keep], rank[keep], owner[keep]
            at = at - np.arange(len(at))                # one part went from each match before
            size = size - 1
            last = np.cumsum(size) - 1
            rank[at] = self.none
            right = at[at < last]
            left = at[at > last - size + 1] - 1
            rank[right] = self.rank(part[right], part[right + 1])
            rank[left] = self.rank(part[left], part[left + 1])
        return out


def merge(token: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """Ids of one match: always merge the adjacent pair of lowest rank, leftmost first."""
    n = len(token)
    after = list(range(1, n + 1))      # where the part that starts here ends
    before = list(range(-1, n - 1))    # where the part before it starts
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = rank_of.get(token[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue                   # one of the two parts has been merged meanwhile
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            rank = rank_of.get(token[i:after[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, after[end]))
        p = before[i]
        if p >= 0:
            rank = rank_of.get(token[p:end])
            if rank is not None:
                heapq.heappush(heap, (rank, p, end))
    out, i = [], 0
    while i < n:
        out.append(rank_of[token[i:after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts in a task; the vocabulary and the perfect hash are given."""

    def __init__(self, vocabulary: list[bytes], table: PerfectHash, pairs: Pairs, pattern: str):
        self.vocabulary, self.table, self.pairs = vocabulary, table, pairs
        self.rank_of = {t: i for i, t in enumerate(vocabulary)}
        self.find = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """Put the packed ids of new matches into the memo; those of long ones are returned, not kept."""
        if self.size > MEMO_BYTES:
            self.old, self.young, self.size = self.young, {}, 0
        fresh, long = [], {}
        for m in matches:
            if m in self.old:
                self._keep(m, self.old[m])
            elif m not in self.young:
                fresh.append(m)
        raw = [m.encode() for m in fresh]
        short, tokens = [], []
        for m, token, key in zip(fresh, raw, self.table.find(raw).tolist() if raw else ()):
            if self.vocabulary[key] == token:
                ids = [key]
            elif len(m) <= LONG:
                short.append(m)
                tokens.append(token)
                continue
            else:
                ids = merge(token, self.rank_of)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(m) > LONG:
                long[m] = packed
            else:
                self._keep(m, packed)
        for m, packed in zip(short, self.pairs.merge(tokens) if tokens else ()):
            self._keep(m, packed)
        return long

    def _keep(self, match: str, packed: bytes) -> None:
        if match not in self.young:
            self.size += 200 + 4 * len(match) + len(packed)      # with the objects' own bytes
            self.young[match] = packed

    def encode(self, texts: list[str]) -> list[bytes]:
        matches = [self.find(t) for t in texts]
        long = self.learn(set().union(*matches))
        get = {**self.young, **long}.__getitem__ if long else self.young.__getitem__
        return [b"".join(map(get, m)) for m in matches]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
           carry: list[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, n_tokens and ids: every whole text encoded, ids packed as ``<u4``."""
    vocabulary = read_ranks(ranks_path)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, PerfectHash(vocabulary), Pairs(vocabulary), pattern))
    names = [*carry] if text_col in carry else [*carry, text_col]
    at, n = names.index(text_col), len(carry)
    schema = T.StructType([docs.schema[c] for c in carry] + [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shipped.value)
        for batch in batches:
            for lo, hi in slices(column_bytes(batch.column(at))[0], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                ids = encoder.encode([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=[*carry, "n_tokens", "ids"])

    return by_batches(docs.select(*names), run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the bytes that packed ids stand for."""
    spark = encoded.sparkSession
    shipped = spark.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType(encoded.schema.fields + [T.StructField("decoded", T.BinaryType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shipped.value.__getitem__
        for batch in batches:
            for lo, hi in slices(column_bytes(batch.column(at))[0], SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                decoded = [b"".join(map(get, np.frombuffer(x or b"", "<u4").tolist()))
                           for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())],
                                                 names=[*part.schema.names, "decoded"])

    return by_batches(encoded, run, schema)
