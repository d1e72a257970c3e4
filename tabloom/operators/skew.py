"""Joins on keys that may hold any share of the rows, or be null, without their rows meeting in one task.

A fitted table has one row a key. A heavy key's row is copied, and the facts of the key are dealt to the copies; facts
with a null key, which match nothing, are dealt out, too. Heavy keys are found by a count: those with more than a share
of 1 / SHARES of all rows, so they are fewer than SHARES and have fewer than 2 * SHARES copies, whatever the size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tabloom.sources.staging import staged

#: Inverse of the share of rows that makes a key heavy, and rows below which none is.
SHARES, HEAVY_ROWS = 1024, 100_000
#: Places that rows with a null key are dealt to.
NULL_PLACES = 1024
#: Rows of a fitted table that checked_join() broadcasts at most.
FEW_KEYS = 100_000


def heavy_keys(counts: DataFrame, keys: Sequence[str], rows: str) -> list[Row]:
    """(keys, _copies) of the keys without a null that hold more than their share: fewer than SHARES rows."""
    share = F.greatest(F.col("_total") / SHARES, F.lit(float(HEAVY_ROWS)))
    total = counts.agg(F.sum(rows).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col(rows) > share).dropna(subset=list(keys)).select(*keys, F.ceil(F.col(rows) / share).cast("int").alias("_copies")).collect()


def checked_join(df: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of df with fitted, one row a key: a broadcast of up to FEW_KEYS rows, which a count checks, so that df does not move; beyond, dealt_join()."""
    known = staged(fitted)
    if known.count() > FEW_KEYS:
        return dealt_join(df, known, keys)
    return df.join(F.broadcast(known), list(keys), "left").select(*df.columns, *(c for c in known.columns if c not in keys))


def dealt_join(df: DataFrame, fitted: DataFrame, keys: Sequence[str], how: str = "left", rows: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """df joined with fitted, one row a key, on equally named keys. Columns of df come first, then those of fitted.

    Keys are counted by `counts` (keys, _rows), by fitted's column `rows`, which does not go into the result, or else by df
    itself, with partial sums before the shuffle.
    """
    keys = list(keys)
    if counts is None:
        counts = fitted.select(*keys, F.col(rows).alias("_rows")) if rows else df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    right = fitted.drop(rows) if rows else fitted
    new = [c for c in right.columns if c not in keys]
    heavy = heavy_keys(counts, keys, "_rows")
    deal = F.monotonically_increasing_id()
    missing = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    place = F.when(missing, deal % NULL_PLACES).otherwise(0)
    if not heavy:
        left, copied = df.withColumn("_place", place.cast("int")), right.withColumn("_place", F.lit(0))
    else:
        known = F.broadcast(df.sparkSession.createDataFrame(heavy, counts.select(*keys).schema.add("_copies", IntegerType())))
        left = df.join(known, keys, "left").withColumn("_place", F.coalesce(deal % F.col("_copies"), place).cast("int")).drop("_copies")
        copied = right.join(known, keys, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return left.join(copied, [*keys, "_place"], how).select(*df.columns, *new)
