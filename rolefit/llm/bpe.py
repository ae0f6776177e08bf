"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the whole vocabulary answers for every pre-token that is itself a vocabulary entry
with one probe and one comparison. Tier two: any other pre-token is merged bottom-up: up to SHORT_PIECE bytes by the least of all its pairs,
longer ones with their bytes in a linked list and their adjacent pairs in a heap ordered by rank and position, so that a pre-token of n bytes costs O(n log n)
however long it is.

The vocabulary is read on the driver from a path that the caller names and broadcast; its size is checked against MAX_VOCABULARY.
A map without any shuffle: a lost executor costs the tasks it was running.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import text_slices

#: Entries of the largest vocabulary that is broadcast.
MAX_VOCABULARY = 2_000_000
#: Pre-tokens in each of the two generations whose ids a worker remembers, and the characters of the longest one that it does. Results do not
#: depend on them.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 32
#: Bytes of the longest piece that is merged by looking through all of its pairs; the heap is for longer ones. Results do not depend on it.
SHORT_PIECE = 24

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks file: one base64 entry and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class PerfectHash:
    """Minimal perfect hash of byte strings: bucket displacement, so that n keys fill n slots without a gap.

    A bucket of several keys stores the displacement that sends all of them to free slots; a bucket of one key stores its
    slot itself, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % self.buckets].append((h, key))
        self.shift = np.zeros(self.buckets, np.int64).tolist()
        self.slots: list[bytes | None] = [None] * n
        free_from = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if len(members) > 1:
                d = 1
                while True:
                    at = [self._place(h, d) for h, _ in members]
                    if len(set(at)) == len(at) and all(self.slots[s] is None for s in at):
                        break
                    d += 1
                self.shift[b] = d
                for s, (_, key) in zip(at, members):
                    self.slots[s] = key
            elif members:
                while self.slots[free_from] is not None:
                    free_from += 1
                self.shift[b] = -free_from - 1
                self.slots[free_from] = members[0][1]

    def _place(self, h: int, d: int) -> int:
        x = (h ^ (d * _ODD & _MASK)) * 0xD6E8FEB86659FD93 & _MASK  # the displacement scrambles, so that no two keys keep their distance
        return ((x ^ (x >> 32)) * 0xA0761D6478BD642F & _MASK) % self.n

    def find(self, key: bytes) -> int:
        """The slot of the key, or -1 if it is none of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._place(h, d)
        return slot if self.slots[slot] == key else -1


class Codec:
    """Vocabulary, perfect hash and pattern; small enough to be broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(ranks)} entries is larger than {MAX_VOCABULARY}")
        self.ranks, self.pattern = ranks, pattern
        self.table = PerfectHash(list(ranks))
        self.slot_ids = [ranks[key] for key in self.table.slots]
        self.bytes_of = {rank: key for key, rank in ranks.items()}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece that is no vocabulary entry: the pair of least rank, the leftmost among equals, is merged until none is left."""
        rank_of, n = self.ranks.get, len(piece)
        if n <= SHORT_PIECE:
            return self._merge_short(piece)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [rank_of(piece[i:i + 2], -1) for i in range(n - 1)]
        heap = [(rank << 40) + i for i, rank in enumerate(pair) if rank >= 0]
        pair.append(-1)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            if pair[i] != top >> 40:  # this pair has changed since
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                rank = pair[i] = rank_of(piece[i:after[end]], -1)
                if rank >= 0:
                    heappush(heap, (rank << 40) + i)
            else:
                pair[i] = -1
            if i:
                left = before[i]
                rank = pair[left] = rank_of(piece[left:end], -1)
                if rank >= 0:
                    heappush(heap, (rank << 40) + left)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return tuple(ids)

    def _merge_short(self, piece: bytes) -> tuple[int, ...]:
        rank_of, none = self.ranks.get, 1 << 40
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [rank_of(piece[i:i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank_of(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + parts[i], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def piece_ids(self, piece: bytes) -> tuple[int, ...]:
        slot = self.table.find(piece)
        return (self.slot_ids[slot],) if slot >= 0 else self.merge(piece)


class _Seen(dict):
    """Ids by pre-token, worked out at the first sight of one; the generation before is kept until this one is full too."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.find, self.earlier = codec.piece_ids, {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.earlier.get(token)
        if ids is None:
            ids = self.find(token.encode("utf-8", "surrogatepass"))
            if len(token) > REMEMBERED_LENGTH:
                return ids
        if len(self) >= REMEMBERED:
            self.renew()
        self[token] = ids
        return ids

    def renew(self) -> None:
        self.earlier = dict(self)
        self.clear()


def encoder(codec: Codec) -> Callable[[str], list[int]]:
    split, seen = regex.compile(codec.pattern).findall, _Seen(codec)

    def encode(text: str) -> list[int]:
        return list(chain.from_iterable(map(seen.__getitem__, split(text))))

    return encode


def decode_ids(codec: Codec, ids: list[int]) -> bytes:
    return b"".join(map(codec.bytes_of.__getitem__, ids))


def encode_decode(docs: DataFrame, codec: Codec, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """One row per input row: key, token_ids array<int> and, unless decoded=False, the bytes that the ids decode to.

    A null or empty text has no ids and decodes to no bytes. Repeated rows and keys stay repeated. Other columns, whatever
    their names, are not read and not returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    key_type = docs.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        encode = encoder(own)
        for part, texts in text_slices(batches, "text"):
            lists = [encode(t) for t in texts]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = pa.array(np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1])))
            columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)]
            if decoded:
                columns.append(pa.array([decode_ids(own, x) for x in lists], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["key", "token_ids", "decoded"][:len(columns)])

    schema = f"key {key_type}, token_ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(step, schema).withColumnRenamed("key", key)


def digest_table(encoded: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and digests of what encode_decode returns."""
    return encoded.select(
        key, F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *keep)
