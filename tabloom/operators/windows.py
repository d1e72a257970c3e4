"""Rolling statistics over the last rows of an entity, whatever share of all rows it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators import order as ranges


def rolling(value: str, keys: Sequence[str], order: Sequence[str], size: int) -> dict[str, Column]:
    """Mean, median, min, max, deviation and corrected skewness of the last `size` rows; nulls are skipped.

    Deviation is that of a sample, 0 for one value; skewness is 0 for fewer than three values or no variance. All
    columns share one window, so an entity is sorted once.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)
    x = F.col(value)
    n = F.count(x).over(w)
    std = F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))
    skew = F.skewness(x).over(w) * F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0))
    fair = (n >= 3) & (std > 0)
    return {
        f"{value}_mean": F.avg(x).over(w),
        f"{value}_median": F.percentile(x, F.lit(0.5)).over(w),
        f"{value}_min": F.min(x).over(w),
        f"{value}_max": F.max(x).over(w),
        f"{value}_std": std,
        f"{value}_skew": F.when(fair, skew).otherwise(0.0),
    }


def add_rolling(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], sizes: Sequence[int], rows: int | None = None) -> DataFrame:
    """Adds what rolling() gives for each window length, named {value}_{statistic}_{length}; all lengths share one sort.

    `order` tells a key's rows apart. If a key has more than `rows` rows, all are cut in chunks of that many in the order of
    (keys, order), and each chunk starts with the rows of the one before that its windows reach (its halo).
    """
    rows = max(rows or ranges.CHUNK_ROWS, max(sizes))
    by, along, out = list(keys), list(order), df
    hot = ranges.longest(df, keys) > rows
    if hot:
        placed = ranges.chunked(df, keys, order, rows)
        reaches = F.col("_no") % rows >= rows - max(sizes) + 1
        out = placed.withColumn("_own", F.col("_chunk")).withColumn("_chunk", F.explode(F.when(reaches, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
        by, along = ["_chunk", *keys], ["_no"]
    out = out.select("*", *(c.alias(f"{k}_{size}") for size in sizes for k, c in rolling(value, by, along, size).items()))
    return out.where("_chunk = _own").drop("_no", "_chunk", "_own") if hot else out
