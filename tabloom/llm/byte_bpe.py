"""Operator 2: byte-level BPE encoding and decoding.

A pre-token that is in the vocabulary is resolved by one probe of a minimal perfect hash. Any other is split into
bytes, and a heap of adjacent pairs merges the lowest rank first (leftmost on ties) over a linked list of bytes.
The hash is built once on the driver and broadcast; its size is that of the vocabulary, which is checked.

Null and empty texts encode to no ids. A pre-token of any length costs n log n. Repeated rows give repeated rows, an empty table
none; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import Memo, table, texts

#: The largest vocabulary that may be broadcast.
MAX_VOCABULARY = 2_000_000
_MASK = (1 << 64) - 1
_GOLDEN, _MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD


class MinimalPerfectHash:
    """Hash-and-displace: n keys to n slots, with each key stored at its slot to reject strangers."""

    def __init__(self, items: dict[bytes, int]):
        n = self.n = len(items)
        self.buckets = max(1, n // 2)
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        self.shift = [0] * self.buckets
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in items:
            h = xxhash.xxh3_64_intdigest(key)
            groups[h % self.buckets].append((h, key))
        taken = bytearray(n)
        order = sorted((b for b in range(self.buckets) if groups[b]), key=lambda b: -len(groups[b]))
        free = 0
        for b in order:
            group = groups[b]
            if len(group) == 1:  # a lone key takes the next free slot; the shift names it
                while taken[free]:
                    free += 1
                slots, self.shift[b] = [free], -free - 1
            else:
                d = 0
                while True:
                    d += 1
                    slots = [self._slot(h, d) for h, _ in group]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                self.shift[b] = d
            for s, (_, key) in zip(slots, group, strict=True):
                taken[s], self.keys[s], self.values[s] = 1, key, items[key]

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * _GOLDEN)) & _MASK) * _MIX & _MASK) >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


class ByteBpe:
    """Encoder and decoder over a rank table."""

    def __init__(self, hashed: MinimalPerfectHash, pattern: str):
        self.hashed = hashed
        self.find = regex.compile(pattern).findall
        self.memo = Memo(self._piece)
        self.spaced = Memo(lambda word: self._chunk(" " + word))
        self.odd_space = re.compile(r" \s|\s |\A | \Z").search
        self.bytes_of = dict(zip(hashed.values, hashed.keys, strict=True))
        self.rank_of = dict(zip(hashed.keys, hashed.values, strict=True))

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.hashed.get(raw)
        return (whole,) if whole >= 0 else tuple(self._merge(raw))

    def _merge(self, raw: bytes) -> list[int]:
        n, rank = len(raw), self.rank_of.get
        bits = n.bit_length() + 1
        low = (1 << bits) - 1
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        # An entry holds the pair's rank, start and end, in one integer; the smallest rank leaves first, then the leftmost.
        heap = [(((r << bits) | i) << bits) | (i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2], -1)) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end, i = entry & low, (entry >> bits) & low
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue  # one side has been merged since
            after[i], after[j] = end, -1
            if end < n:
                before[end] = i
                to = after[end]
                if (r := rank(raw[i:to], -1)) >= 0:
                    heappush(heap, (((r << bits) | i) << bits) | to)
            if (p := before[i]) >= 0 and (r := rank(raw[p:end], -1)) >= 0:
                heappush(heap, (((r << bits) | p) << bits) | end)
        out, i = [], 0
        while i < n:
            out.append(rank(raw[i : after[i]]))
            i = after[i]
        return out

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        found = self.find(chunk)
        return self.memo[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(self.memo.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        """No match of the pattern goes on over a space between two characters that are none: such a text is cut there."""
        if self.odd_space(text):
            return list(chain.from_iterable(map(self.memo.__getitem__, self.find(text))))
        first, *rest = text.split(" ")
        out = list(self._chunk(first)) if first else []
        out.extend(chain.from_iterable(map(self.spaced.__getitem__, rest)))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, space, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_BUILT: dict[tuple[str, str], ByteBpe] = {}


def _codec(shipped, ranks_path: str, pattern: str) -> ByteBpe:
    """A worker's codec, which outlives a task so that its memo does too."""
    if (key := (ranks_path, pattern)) not in _BUILT:
        _BUILT[key] = ByteBpe(shipped.value, pattern)
    return _BUILT[key]


def _shipped(spark: SparkSession, ranks_path: str):
    ranks = load_ranks(ranks_path)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} ranks; a broadcast vocabulary has {MAX_VOCABULARY} at most")
    return spark.sparkContext.broadcast(MinimalPerfectHash(ranks))



def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>, n_tokens): the ids of every whole text."""
    shipped = _shipped(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped, ranks_path, pattern)
        Memo.keep(codec.memo, codec.spaced)
        for b in batches:
            ids = [codec.encode(t) for t in texts(b, text_col)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64())], [id_col, "ids", "n_tokens"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>, n_tokens bigint")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary). Null ids decode to no bytes; an id outside the vocabulary raises."""
    shipped = _shipped(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped, ranks_path, public_tokenizers.PATTERN)
        for b in batches:
            out = [codec.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, decoded binary")


def round_trip_digests(
    docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, decode and digest in one pass, so that ids need not leave the worker."""
    shipped = _shipped(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped, ranks_path, pattern)
        Memo.keep(codec.memo, codec.spaced)
        spelled: dict[int, str] = {i: str(i) for i in codec.hashed.values}
        for b in batches:
            n, shas, decoded = [], [], []
            for t in texts(b, text_col):
                ids = codec.encode(t)
                n.append(len(ids))
                shas.append(hashlib.sha256(" ".join(map(spelled.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
