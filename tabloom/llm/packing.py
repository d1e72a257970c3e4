"""Operator 6: best-fit packing by the sum of squares.

Every document becomes tokens and an end id, is cut into pieces only where it is longer than a sequence, and each piece
is placed in the open sequence (or a new one) that makes the sum over residual gaps of squared counts of open sequences
smallest. Pieces are dealt by a hash to shards of about SHARD_PIECES, which are packed independently: a shard leaves at
most a few dozen sequences unfilled, and no task sees more than one shard. The hash is of a number of the row's own, so
equal rows and null ids spread over all shards. Within a shard, pieces come by powers of two of their length, the longest
first, and in the order of a hash within a power, so that short ones fill what the long ones leave.

Ids are those that the tokenizers library gives as it loads the file: special tokens that a text spells out are
recognised. Null and empty texts are one piece that holds the end id. Ties between gaps go to the smallest gap. Rows that
repeat an id are packed as documents of their own. An empty table gives no rows. Texts of any length are cut, never
dropped. Only the id and text columns are read, so names of others cannot clash.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm.common import Memo, table, texts, written

CAPACITY = 2048
END_ID = 0
#: Pieces in one shard, on average.
SHARD_PIECES = 60_000


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()

#: Where the letters end whose classes, cases and composed forms all libraries agree on.
LATIN_END = 0x250


def _latin_words() -> re.Pattern[str]:
    """The tokenizer's splitter for lower-cased texts below LATIN_END, with its classes of letters, numbers and spaces spelled out."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, spaces = of("L"), of("N"), "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


class WordEncoder:
    """The word tokenizer, with a memo of words: after its normaliser and splitter, words are encoded independently.

    Texts that are below LATIN_END in lower case are split here in one pass, others chunk by chunk by the tokenizer's own parts.
    Only words that the memo lacks go through the tokenizer's model. Added tokens that the text spells out get their ids
    first, as the tokenizer does.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = _latin_words().findall
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self.words = Memo(self._word)
        self.chunks = Memo(self._chunk)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {content: int(i).to_bytes(4, "little") for content, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def _word(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def _chunk(self, chunk: str) -> bytes:
        plain = self.tokenizer.normalizer.normalize_str(chunk)
        return b"".join(t.id.to_bytes(4, "little") for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain) for t in self.model.tokenize(piece))

    def _plain(self, text: str) -> bytes:
        lower = text.lower()
        if lower.isascii() or not self.beyond(lower):
            return b"".join(map(self.words.__getitem__, self.find(lower)))
        # No word holds a space, and the normaliser never joins text across one.
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text."""
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        return np.frombuffer(b"".join(self.added.get(part) or self._plain(part) for part in self.cut.split(text)), "<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, _row): what there is to pack; _row tells rows apart that are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        Memo.keep(enc.words, enc.chunks)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(texts(b, text_col)):
                ids = np.concatenate([enc.encode(t), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), b.column(2).take(at)],
                [id_col, "piece", "start", "length", "ids_crc32", "_row"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(run, f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _row bigint")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing of one shard: a bin and an offset for each length, given in the order of placing.

    With N(g) open bins of gap g, a piece of length s put into gap g changes the sum of squares by
    2 N(g - s) + 1 - (2 N(g) - 1); a full bin has left the sum, and a new one only adds 2 N(capacity - s) + 1.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_bins = 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    never = np.int64(1) << 60
    for k, s in enumerate(lengths.tolist()):
        if s < capacity:
            here = count[s:]
            change = 2 * (count[: capacity + 1 - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = never
            g = s + int(change.argmin())
            if 2 * int(count[capacity - s]) + 1 < change[g - s]:
                g = capacity
        else:
            g = capacity
        if g == capacity:
            b, n_bins = n_bins, n_bins + 1
        else:
            b = open_bins[g].pop()
            count[g] -= 1
        bins[k], offsets[k] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to what pieces() returns, once that is written; a shard's order is a hash of row and piece."""
    shards = max(1, -(-parts.count() // shard_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        Memo.keep()
        pdf["_class"] = -np.frexp(pdf["length"].to_numpy(np.float64))[1]
        pdf = pdf.sort_values(["_class", "_order", "_row", "piece"], kind="stable").reset_index(drop=True)
        bins, offsets = place(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (pdf["_shard"].to_numpy(np.int64) << 40) | bins
        pdf["offset"] = offsets
        return pdf.drop(columns=["_shard", "_order", "_class", "_row"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != "_row") + ", sequence_id bigint, offset bigint"
    dealt = parts.withColumn("_order", F.xxhash64("_row", "piece", "ids_crc32")).withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards)).cast("int"))
    return dealt.groupBy("_shard").applyInPandas(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents. The pieces are written once, so that texts are tokenised once."""
    return pack(written(pieces(docs, tokenizer_path, capacity, END_ID, id_col, text_col), "pieces"), capacity, shard_pieces)
