"""Blends of predictions, by id or by column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.order import quantiles


def aligned(parts: Sequence[DataFrame], key: str, value: str) -> tuple[DataFrame, list[str]]:
    """One row for each id with p0, p1, ...; an error where an id is missing from a part or repeats in one."""
    names = [f"p{k}" for k in range(len(parts))]
    marked = [p.select(key, F.lit(n).alias("_part"), F.col(value).alias("_p")) for n, p in zip(names, parts, strict=True)]
    both = reduce(DataFrame.unionByName, marked).groupBy(key)
    wide = both.agg(*(F.max(F.when(F.col("_part") == n, F.col("_p"))).alias(n) for n in names), F.count("*").alias("_n"), F.count_distinct("_part").alias("_d"))
    sound = F.when((F.col("_n") == len(names)) & (F.col("_d") == len(names)), F.lit(True)).otherwise(F.raise_error(F.lit("predictions do not have the same ids")))
    return wide.where(sound).drop("_n", "_d"), names


def log_mean(columns: Sequence[str]) -> Column:
    """Geometric mean of positive predictions."""
    return F.exp(sum((F.log(c) for c in columns), F.lit(0.0)) / len(columns))


def harmonic(columns: Sequence[str]) -> Column:
    """1 / sum(1 / p), without the factor of their number."""
    return 1 / sum((1 / F.col(c) for c in columns), F.lit(0.0))


def row_max(columns: Sequence[str]) -> Column:
    return F.greatest(*columns)


def log_sum_exp(columns: Sequence[str], shifted: bool = True) -> Column:
    """ln(sum(exp(c))), shifted by the greatest so that it cannot overflow; without the shift it is infinite from about 709.78."""
    if not shifted:
        return F.log(sum((F.exp(c) for c in columns), F.lit(0.0)))
    top = F.greatest(*columns)
    return top + F.log(sum((F.exp(F.col(c) - top) for c in columns), F.lit(0.0)))


def weighted(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def tail_adjust(df: DataFrame, column: str, low: float = 0.0042, high: float = 0.99, shrink: float = 0.77, grow: float = 1.1, accuracy: int | None = None) -> DataFrame:
    """Below the low quantile times `shrink`, then at or above the high one times `grow`; both quantiles are taken first."""
    found = quantiles(df, [column], [low, high], accuracy).get(column)
    if found is None:
        return df
    lowered = F.when(F.col(column) < found[0], F.col(column) * shrink).otherwise(F.col(column))
    return df.withColumn(column, lowered).withColumn(column, F.when(F.col(column) >= found[1], F.col(column) * grow).otherwise(F.col(column)))
