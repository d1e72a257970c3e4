"""Folds and random splits. A global number never sorts in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.keys import BUCKETS, bucket
from tabloom.operators.order import global_row_number


def kfold_shuffled(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold, equal in size within one row, in the order of a hash of the key."""
    return global_row_number(df, bucket(key, seed), key).withColumn("fold", (F.col("row_no") % k).cast("int")).drop("row_no")


def kfold_contiguous(df: DataFrame, key: str, k: int) -> DataFrame:
    """Adds fold: k blocks in the order of the key."""
    total = df.agg(F.count("*").alias("_total"))
    numbered = global_row_number(df, key).crossJoin(F.broadcast(total))
    return numbered.withColumn("fold", F.floor(F.col("row_no") * k / F.col("_total")).cast("int")).drop("row_no", "_total")


def kfold_stratified(df: DataFrame, key: str, label: str, k: int, seed: int = 0, parts: int = 64) -> DataFrame:
    """Adds fold, equal in size within each class. A class is numbered in `parts` ranges of the hash, not in one task."""
    h = bucket(key, seed)
    ranged = df.withColumns({"_h": h, "_range": F.floor(h * parts / BUCKETS).cast("int")})
    counts = ranged.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(label).alias("_label"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    joined = ranged.join(before, (F.col(label).eqNullSafe(F.col("_label"))) & (F.col("_range") == F.col("_r")))
    own = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key)) - 1
    return joined.withColumn("fold", ((own + F.col("_before")) % k).cast("int")).drop("_h", "_range", "_label", "_r", "_before")


def rotation(df: DataFrame, fold: str, k: int) -> DataFrame:
    """Each row once for each round: test where its fold is the round, valid where it is the next, else train."""
    out = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    part = F.when(F.col(fold) == F.col("round"), "test").when(F.col(fold) == (F.col("round") + 1) % k, "valid").otherwise("train")
    return out.withColumn("part", part)


def split_by_fraction(df: DataFrame, key: str, valid: float, seed: int = 0, name: str = "by_fraction") -> DataFrame:
    return df.withColumn(name, F.when(bucket(key, seed) < int(valid * BUCKETS), "valid").otherwise("train"))


def split_by_size(df: DataFrame, key: str, n_valid: int, seed: int = 0, name: str = "by_size") -> DataFrame:
    """The n_valid rows of the smallest hashes are valid."""
    numbered = global_row_number(df, bucket(key, seed), key)
    return numbered.withColumn(name, F.when(F.col("row_no") < n_valid, "valid").otherwise("train")).drop("row_no")
