"""Operator 8: quality classifier, logistic regression over hashed word n-grams.

Words and runs of punctuation, lower-cased, are hashed; a text's features are its single words and adjacent pairs (a
pair of the same word is one feature, whatever the word), weighted by their share of the text. Training is
follow-the-regularised-leader with per-coordinate rates over a bounded sample of labelled rows (TRAIN_ROWS, chosen by a
hash of the id) in one task; scoring is a sparse dot product in a pass over all rows.

Null and empty texts score by the bias alone. With no usable label every score is 0.5. Several labels of one id count as
their mean, a half as 1; null labels and ids are not used. Repeated rows get equal scores, and an empty table none. Texts
of any length are scored whole. Only the named columns are read, so others cannot clash; in add_quality() the input's column of the score's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import Memo, table, texts

BITS = 18
#: Labelled rows that training uses at most.
TRAIN_ROWS = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
#: What a feature that is all of a text weighs.
SCALE = 16.0

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_PAIR, _SPREAD, _SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x5851F42D4C957F2D)
_CHUNKS = Memo(lambda chunk: tuple(xxhash.xxh3_64_intdigest(t.encode()) for t in _TOKENS(chunk.lower())))


def features(text: str) -> np.ndarray:
    """Hashed indices of the words and pairs of a text, one for each occurrence."""
    words = np.fromiter(chain.from_iterable(map(_CHUNKS.__getitem__, text.split())), np.uint64)
    pairs = np.where(words[1:] == words[:-1], _SAME, (words[:-1] * _PAIR) ^ words[1:])
    return ((np.concatenate([words, pairs]) * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features and their counts."""
    return np.unique(features(text), return_counts=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of (features, counts, label), taken in the order given."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    sparse = [(np.append(at, size), np.append(count * (SCALE / max(1, count.sum())), 1.0), float(label)) for at, count, label in rows]
    weigh = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(epochs):
        for at, x, y in sparse:
            w = weigh(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weigh(z, n)
    return w[:size], float(w[size])


def score_text(text: str, w: np.ndarray, bias: float) -> float:
    found = features(text)
    return float(1 / (1 + np.exp(-np.clip(bias + w[found].sum() * (SCALE / max(1, len(found))), -35, 35))))


def held_out(id_col: str) -> F.Column:
    """The rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled rows that are not held out."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id is not null and _y is not null").where(~held_out("_id"))
    sample = usable.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # train_rows bounds the broadcast side; an id that repeats in docs contributes its smallest text.
    chosen = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id")
    chosen = chosen.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep(_CHUNKS)
        for b in batches:
            found = [counted(t) for t in texts(b, "_text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([at for at, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int32()))], ["id", "y", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep()
        rows = []
        for b in batches:
            for k in range(b.num_rows):
                rows.append((b.column(0)[k].as_py(), b.column(1)[k].as_py(), *(b.column(c)[k].values.to_numpy() for c in (2, 3))))
        rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[0]))
        w, bias = train_ftrl([(at, n, y) for _, y, at, n in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*w[at].tolist(), bias], pa.float64())], ["at", "w"])

    # One task trains, on features alone: a row has 2**BITS of them at most, however long its text is.
    kind = docs.schema[id_col].dataType.simpleString()
    rows = chosen.select("_id", "_y", "_text").mapInArrow(hashed, f"id {kind}, y int, at array<int>, n array<int>")
    w, bias = np.zeros(1 << BITS), 0.0
    for at, value in rows.repartition(1).mapInArrow(run, "at int, w double").toPandas().itertuples(index=False):
        if at >= 0:
            w[at] = value
        else:
            bias = value
    return w, bias


def add_quality(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score, 0 to 1. The weights are 2**BITS numbers, whatever the input's size."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shipped.value
        Memo.keep(_CHUNKS)
        for b in batches:
            scores = [score_text(t, w, bias) for t in texts(b, text_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, score_col])

    schema = docs.select(kept).schema.add(score_col, "double")
    return docs.select(kept).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
