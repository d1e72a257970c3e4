"""Operator 1: token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's matches in a word by their end; a dynamic programme carries, for each
end, the best score and the number of pieces of that best path. No piece is ever built. Ties are the tokenizer's own: a
later candidate must score strictly more, and candidates for an end come in the order of their starts. A character that
no piece covers alone costs the lowest score less 10, and counts as its bytes where the vocabulary has all byte pieces
(else a run of such characters counts as one).

The vocabulary is a public piece file, read as a unigram vocabulary (pieces and scores as they stand); words are cut
before every word mark, so a memo of words gives the exact count of a whole text.

Null and empty texts have no tokens. A text of any length is counted whole, word by word, and a word of any length in one
pass. Repeated rows give repeated rows, an empty table none. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import Memo, table, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_VOCABULARY = 2_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + size]
            at += size


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a piece file, in the order of their ids."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
    return out


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        have = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in have for b in range(256))
        self.tails = Memo(lambda tail: self.word(MARK + tail))

    def word(self, word: str) -> int:
        """Pieces of the best path over a word."""
        n = len(word)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0
        best, pieces, single = None, 0, False
        for last, (length, s) in self.automaton.iter(word) if len(self.automaton) else ():
            while done < last:  # the matches that end at `done` have all been seen
                done += 1
                self._close(word, done, best, pieces, single, score, count, unknown)
                best, pieces, single = None, 0, False
            candidate = score[last + 1 - length] + s
            if best is None or candidate > best:
                best, pieces = candidate, count[last + 1 - length] + 1
            single = single or length == 1
        while done < n:
            done += 1
            self._close(word, done, best, pieces, single, score, count, unknown)
            best, pieces, single = None, 0, False
        return count[n]

    def _close(self, word, end, best, pieces, single, score, count, unknown) -> None:
        """Fix what is known of the paths to `end`."""
        if not single and (best is None or score[end - 1] + self.unknown > best):
            fused = unknown[end - 1] and not self.bytes
            best = score[end - 1] + self.unknown
            pieces = count[end - 1] + (len(word[end - 1].encode()) if self.bytes else 1 - fused)
            unknown[end] = True
        score[end], count[end] = best, pieces

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, *tails = text.replace(" ", MARK).split(MARK)
        total = sum(map(self.tails.__getitem__, tails))
        return total + self.tails[first] if first else total


_COUNTERS: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_chars) for every whole text."""
    vocabulary = load_pieces(pieces_path)
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"{len(vocabulary)} pieces; a broadcast vocabulary has {MAX_VOCABULARY} at most")
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces_path not in _COUNTERS:
            _COUNTERS[pieces_path] = UnigramCounter(shipped.value)
        counter = _COUNTERS[pieces_path]
        Memo.keep(counter.tails)
        for b in batches:
            found = texts(b, text_col)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(counter.count, found)), pa.int64()), pa.array(list(map(len, found)), pa.int64())], [id_col, "n_tokens", "n_chars"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, n_chars bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
