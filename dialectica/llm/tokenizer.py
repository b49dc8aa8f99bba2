"""Byte-level BPE encoding of whole corpora with a public vocabulary (problem 6).

The merge loop is a hierarchical-bitmap rank queue: one bucket for each merge rank holds the positions (nodes of a
linked list over the pre-token's symbols) where that merge applies; a three-level bitmap over the ranks finds the
lowest filled bucket by find-first-set; entries whose symbols have changed meanwhile are stale and skipped. Every
merge costs a bounded number of word operations and one step of its bucket's heap, which keeps the positions in order
(logarithmic in the bucket's size), so a pre-token of a million characters is encoded in time close to linear, where a
rescan of all pairs would be quadratic.

Defined results: null and empty texts give an empty list; blank texts are encoded as they are; strings that spell a
special token are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectica.session import spread

#: The split pattern that belongs to the vocabulary byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens kept with their ids in a worker: entries, and bytes of the longest one kept.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 64
#: Rows in one output batch are bounded by this many ids, so that long texts cannot pile up in memory.
BATCH_IDS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class RankQueue:
    """Positions in buckets by rank; the least rank is found through three levels of 64-bit words."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def first(self) -> int:
        """The least rank with a bucket, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        w = self.mid[b]
        a = b << 6 | (w & -w).bit_length() - 1
        w = self.low[a]
        return a << 6 | (w & -w).bit_length() - 1

    def clear(self, rank: int) -> None:
        del self.buckets[rank]
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)


class Encoder:
    """Encodes texts with the vocabulary and merges of a byte-level BPE file (JSON text)."""

    def __init__(self, model: str) -> None:
        m = json.loads(model)["model"]
        vocab: dict[str, int] = m["vocab"]
        self.byte_ids = [vocab[s] for s in byte_symbols()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(m["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            self.merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            m = merges.get(ids[i] << 20 | ids[i + 1])
            if m:
                queue.push(m[0], i)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            while bucket:
                i = heappop(bucket)
                j = after[i] if ids[i] >= 0 else n
                if j >= n:
                    continue
                m = merges.get(ids[i] << 20 | ids[j])
                if not m or m[0] != rank:
                    continue  # stale: one of the two symbols has been merged away
                ids[i], ids[j] = m[1], -1
                k = after[i] = after[j]
                lower = False
                if k < n:
                    before[k] = i
                    m = merges.get(ids[i] << 20 | ids[k])
                    if m:
                        queue.push(m[0], i)
                        lower = m[0] < rank
                h = before[i]
                if h >= 0:
                    m = merges.get(ids[h] << 20 | ids[i])
                    if m:
                        queue.push(m[0], h)
                        lower = lower or m[0] < rank
                if lower:
                    break
            if not bucket:
                queue.clear(rank)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache, out = self.cache, []
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(piece) <= CACHE_BYTES:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


def read_model(path: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    with open(os.path.join(path, name), encoding="utf-8") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker and broadcast vocabulary."""
    model = shared.value
    if model not in _encoders:
        _encoders.clear()
        _encoders[model] = Encoder(model)
    return _encoders[model]


def encode_column(df: DataFrame, keep: list[str], text: str = "text", ids: str = "ids", path: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """The columns `keep` of df and the token ids of `text`, one row for each row; no shuffle.

    The vocabulary file (a fixed file of 1.6 MB) is read by the driver and broadcast; executors need no copy of it.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_model(path, name))
    schema = df.select(*keep).withColumn(ids, F.expr("cast(null as array<int>)")).schema
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for batch in batches:
            texts = batch.column(n)
            start = 0
            while start < batch.num_rows:
                flat, offsets, row = [], [0], start
                while row < batch.num_rows and len(flat) < BATCH_IDS:
                    flat += encode(texts[row].as_py())
                    offsets.append(len(flat))
                    row += 1
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                cols = [batch.column(k).slice(start, row - start) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*cols, lists], names=[*keep, ids])
                start = row

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, schema)


def count_column(df: DataFrame, keep: list[str], text: str = "text", count: str = "n_tokens", path: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """As encode_column, with the number of ids in place of the ids."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(path, name))
    schema = df.select(*keep).withColumn(count, F.expr("cast(null as bigint)")).schema
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for batch in batches:
            counts = [len(encode(t.as_py())) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), pa.array(counts, pa.int64())], names=[*keep, count])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, schema)
