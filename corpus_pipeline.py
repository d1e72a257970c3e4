"""Corpus pipeline: reject low quality, keep one of near-duplicates, drop repeated passages, mask secrets, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; stages but the last return
the columns of documents. run() writes each stage's rows to the shared folder and reads them back for the next.

Null and empty texts are rows like others: they are scored as empty, are near no text, hold nothing to cut or mask, and pack
as empty documents. Rows that repeat an id or have none count each for itself; of equal texts one row stays. Other columns
pass through, whatever their names. Without usable labels nothing is rejected; an empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import near_dedup, packing, quality, secrets, suffix_dedup
from tabloom.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. It learns from labelled rows of the input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = "_score"
    while score.lower() in map(str.lower, docs.columns):
        score += "_"
    return quality.add_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates, of the smallest id."""
    return near_dedup.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that start earlier in the corpus, in whole characters."""
    return suffix_dedup.remove_repeats(docs, length_col="n_chars")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask and keep the length column true."""
    return secrets.redact(docs, secrets.fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage but the first filter has a form in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
