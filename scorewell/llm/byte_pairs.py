"""Byte-level BPE, encoded in two tiers and decoded again.

Tier one: a minimal perfect hash over the vocabulary answers pre-tokens that are whole tokens. Tier two: all other
pre-tokens are merged with a heap over linked bytes, lowest rank first, leftmost first among equals. Workers keep a bounded
memo of pre-tokens; dropping it changes only speed.

The rank table is read on the driver from a path the caller gives, and broadcast: a vocabulary's size is fixed.

Defined results: NULL text is empty and has no ids; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_ENTRIES = 400_000
KEYS_PER_BUCKET = 4
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys, n slots, one displacement per bucket."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        n = len(ranks)
        self.n_buckets = max(1, -(-n // KEYS_PER_BUCKET))
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        buckets: dict[int, list[bytes]] = {}
        for key in ranks:
            buckets.setdefault(zlib.crc32(key) % self.n_buckets, []).append(key)
        free = [True] * n
        ordered = sorted(buckets.items(), key=lambda b: -len(b[1]))
        singles = [(b, keys[0]) for b, keys in ordered if len(keys) == 1]
        for bucket, keys in ordered:
            if len(keys) == 1:
                break
            seed = 1
            while True:
                slots = {self._slot(k, seed) for k in keys}
                if len(slots) == len(keys) and all(free[s] for s in slots):
                    break
                seed += 1
            self.shift[bucket] = seed
            for k in keys:
                self._put(self._slot(k, seed), k, ranks[k], free)
        left = (i for i, f in enumerate(free) if f)
        for bucket, key in singles:  # a bucket of one key names its slot outright
            slot = next(left)
            self.shift[bucket] = -slot - 1
            self.keys[slot], self.values[slot] = key, ranks[key]

    def _slot(self, key: bytes, seed: int) -> int:
        h = (zlib.crc32(key, seed) ^ (len(key) * 0x9E3779B1) ^ (seed * 0x85EBCA6B)) & 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        return (h ^ (h >> 13)) % len(self.keys)

    def _put(self, slot: int, key: bytes, value: int, free: list[bool]) -> None:
        free[slot] = False
        self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int | None:
        if not self.keys:
            return None
        shift = self.shift[zlib.crc32(key) % self.n_buckets]
        slot = -shift - 1 if shift < 0 else self._slot(key, shift)
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of adjacent pairs over a doubly linked list of parts."""
    n = len(data)
    parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    heap = [(rank, i, 2) for i in range(n - 1) if (rank := get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n:
            continue
        both = left + parts[j]
        if len(both) != size or get(both) != rank:
            continue  # one of the two has grown since
        parts[i], parts[j] = both, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := get(both + parts[k])) is not None:
                heapq.heappush(heap, (rank, i, size + len(parts[k])))
        h = before[i]
        if h >= 0 and (rank := get(parts[h] + both)) is not None:
            heapq.heappush(heap, (rank, h, len(parts[h]) + size))
    return [ranks[p] for p in parts if p is not None]


class Memo(dict):
    """Pre-token -> tuple of ids."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash) -> None:
        self.ranks, self.whole = ranks, whole
        self.numbers = list(range(max(ranks.values(), default=-1) + 1))  # one object per id

    def __missing__(self, token: str) -> tuple[int, ...]:
        data = token.encode("utf-8", "surrogatepass")
        one = self.whole.get(data)
        numbers = self.numbers
        ids = (numbers[one],) if one is not None else tuple([numbers[i] for i in merge_bytes(data, self.ranks)])
        if len(token) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        self.memo = Memo(ranks, PerfectHash(ranks))
        top = max(ranks.values(), default=-1) + 1
        self.decimals = [str(i) for i in range(top)]
        self.tokens = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document the number of ids, the digest of the ids and the digest of the bytes they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scorewell.llm import byte_pairs  # one codec per worker, whatever way this function came here

        if name not in byte_pairs._CODECS:
            byte_pairs._CODECS.clear()
            byte_pairs._CODECS[name] = byte_pairs.Codec(*shared.value)
        codec = byte_pairs._CODECS[name]
        sha = hashlib.sha256
        for batch in batches:
            counts, digests, decoded = [], [], []
            for text in batch["text"].to_pylist():
                ids = codec.encode(text or "")
                counts.append(len(ids))
                digests.append(sha(" ".join(map(codec.decimals.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], schema=SCHEMA)

    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return cut.mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
