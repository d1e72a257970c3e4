"""Helpers that the text operators share: table access, scratch tables and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; bounds a Python worker's memory when texts are long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local master may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tabloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tabloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the cleaner remove shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: Keys that heavy_join() may broadcast: each holds more than its share of the rows, so there cannot be more.
HEAVY_KEYS, HEAVY_ROWS = 10_000, 2_000


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Inner join of left with right, one row a key, whose count_col says how many of left's `total` rows have the key.

    Keys with more than total / HEAVY_KEYS rows are joined by broadcast, without moving left's rows, so none meets its
    rows in one task; there are fewer than HEAVY_KEYS of them whatever the size. The others are shuffled. Both sides
    should be written, as they are read more than once.
    """
    limit = max(total // HEAVY_KEYS, HEAVY_ROWS)
    heavy = right.where(F.col(count_col) > limit)
    if heavy.isEmpty():
        return left.join(right, keys)
    apart = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(heavy), keys).unionByName(apart.join(right.where(F.col(count_col) <= limit), keys))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


#: Entries in one generation of a worker's memo, and the longest key that is kept: together they bound its bytes.
MEMO_ENTRIES, MEMO_KEY = 250_000, 64


class Memo(dict):
    """A memo over a function of a text or bytes, bounded by two generations: a full one becomes the old one. Long keys are not kept."""

    all: ClassVar[list[weakref.ref]] = []

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}
        Memo.all = [*(r for r in Memo.all if r() is not None), weakref.ref(self)]

    @classmethod
    def keep(cls, *mine: Memo) -> None:
        """Empty all memos but these: a worker serves one operator after the other, and holds the memos of one."""
        for ref in cls.all:
            memo = ref()
            if memo is not None and not any(memo is m for m in mine):
                memo.clear()
                memo.old = {}

    def __missing__(self, key):
        if len(key) > MEMO_KEY:
            return self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
