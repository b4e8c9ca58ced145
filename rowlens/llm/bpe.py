"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of tokens. A pair that some token of the
vocabulary spells out waits in the bucket of that token's rank; two levels of
256-bit words tell which buckets are filled, so that finding the first set bit in
two words gives the lowest rank. Buckets hand out their leftmost position
first. An entry whose pair has changed meanwhile is stale and skipped. The time
is O(n log n) in the length of a pre-token, whatever it holds.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Encoded pre-tokens that a worker remembers at most, and the longest of them in characters.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 48


def packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids]) if len(ids) < 12 else np.array(ids, "<u4").tobytes()


class Encoder:
    """Ranks of byte strings; all single bytes must be among them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.byte_ids = [ranks[bytes([i])] for i in range(256)]
        self.spelled = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.ranks = ranks
        # rights[left id][right id]: rank of the token that the two spell
        none: dict[int, int] = {}
        self.rights = [none] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                x, y = ranks.get(token[:k]), ranks.get(token[k:])
                if x is not None and y is not None:
                    if self.rights[x] is none:
                        self.rights[x] = {}
                    self.rights[x][y] = rank
        self.low = [0] * (len(self.rights) + 255 >> 8)
        self.bits = [1 << i for i in range(max(256, len(self.low)))]
        self.buckets: list[list[int] | None] = [None] * len(self.rights)

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        rights, low, buckets, bits, top = self.rights, self.low, self.buckets, self.bits, 0
        ids = [*map(self.byte_ids.__getitem__, data)]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        wanted: list[int | None] = [None] * n  # rank of the pair that starts at a place; other entries in buckets are stale
        for at in range(n - 1):
            wanted[at] = rank = rights[ids[at]].get(ids[at + 1])
            if rank is not None:
                bucket = buckets[rank]
                if bucket is None:
                    buckets[rank] = [at]
                    w = rank >> 8
                    low[w] |= bits[rank & 255]
                    top |= bits[w]
                else:
                    bucket.append(at)  # rising places are a heap
        while top:
            w = (top & -top).bit_length() - 1
            x = low[w]
            x &= -x
            rank = w << 8 | x.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                buckets[rank] = None
                low[w] ^= x
                if not low[w]:
                    top ^= bits[w]
            if wanted[at] != rank:
                continue
            gone = after[at]
            ids[at] = rank
            after[at] = nxt = after[gone]
            wanted[gone] = None
            left = before[at]
            if nxt < n:
                before[nxt] = at
                wanted[at] = new = rights[rank].get(ids[nxt])
                if new is not None:
                    bucket = buckets[new]
                    if bucket is None:
                        buckets[new] = [at]
                        w = new >> 8
                        low[w] |= bits[new & 255]
                        top |= bits[w]
                    else:
                        heappush(bucket, at)
            else:
                wanted[at] = None
            if left >= 0:
                wanted[left] = new = rights[ids[left]].get(rank)
                if new is not None:
                    bucket = buckets[new]
                    if bucket is None:
                        buckets[new] = [left]
                        w = new >> 8
                        low[w] |= bits[new & 255]
                        top |= bits[w]
                    else:
                        heappush(bucket, left)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        cache, out = self.cache, []
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = packed(self.merge(piece.encode()))
                if len(piece) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes | Iterable[int]) -> bytes:
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.spelled.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder a process; without a path the one of byte_bpe_50k.tiktoken."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return Encoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                ids = [np.frombuffer(own.encode(t), "<u4").astype(np.int32) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, np.concatenate(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.decode(x) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """A row of SCHEMA for every row: the ids of the whole text, and what they decode to.

    Row by row and without a shuffle; a null text is an empty one, repeated rows
    give repeated rows, and a null doc_id passes through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            rows = []
            for t in b.column("text"):
                ids = own.encode(t.as_py())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, coded, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.cache.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
