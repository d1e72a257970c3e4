"""Imputation. Group fills fit a small table and join it back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators import order as ranges
from tabloom.operators.order import quantiles_by
from tabloom.operators.skew import dealt_join


def fill_by_kind(df: DataFrame, text: str = "None", number: float = 0) -> DataFrame:
    """Null strings become `text`, null numbers `number`."""
    return df.na.fill(text).na.fill(number)


def fit_mode(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, mode): the most frequent known value, the smallest on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).count()
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("mode"))


def fit_median(df: DataFrame, column: str, keys: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(keys, median) of known values: exact, by ranks in ranges, or approximate. Keys without known values are left out."""
    return quantiles_by(df, keys, column, [0.5], accuracy).select(*keys, F.col("q")[0].alias("median"))


def fill_from(df: DataFrame, fitted: DataFrame, column: str, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """Fills nulls of a column from a fitted table."""
    out = dealt_join(df, fitted, keys) if keys else df.crossJoin(F.broadcast(fitted))  # without keys it is one row
    return out.withColumn(column, F.coalesce(column, by)).drop(by)


def interpolate(value: str, keys: Sequence[str], order: Sequence[str], place: Column | None = None) -> Column:
    """Linear in a row's place within its key, by an order that tells rows apart; edges take the nearest known value; null if none is known."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # What lies ahead is looked up in the reverse order, where it is a running value, too.
    reverse = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    back, ahead = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, reverse))
    place = F.row_number().over(w) if place is None else place
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), place.alias("p")))
    before, after = F.last(known, True).over(back), F.last(known, True).over(ahead)
    between = before["v"] + (after["v"] - before["v"]) * (place - before["p"]) / F.nullif(after["p"] - before["p"], F.lit(0))
    return F.coalesce(F.col(value), between, before["v"], after["v"])


def add_interpolated(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], name: str, rows: int | None = None) -> DataFrame:
    """Adds what interpolate() gives, whatever share of all rows a key holds.

    If a key has more than `rows` rows, all are cut in chunks of that many. The first and the last known value of each key
    and chunk make a small table, in which a running pass finds what is known before and after each; these two are carried
    into the chunk as rows of their own, so that gaps over any number of chunks are filled inside one.
    """
    rows = rows or ranges.CHUNK_ROWS
    if ranges.longest(df, keys) <= rows:
        return df.withColumn(name, interpolate(value, keys, order))
    keys = list(keys)
    placed = ranges.chunked(df, keys, order, rows)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_no").alias("n"), F.col(value).alias("v")))
    ends = placed.groupBy(*keys, "_chunk").agg(F.min(known).alias("_first"), F.max(known).alias("_last"))
    w = Window.partitionBy(*keys)
    before = F.last("_last", True).over(w.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("_first", True).over(w.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1))
    around = ends.select(*keys, "_chunk", F.array(before, after).alias("_around"))
    carried = around.select(*keys, "_chunk", F.explode(F.filter("_around", lambda x: x.isNotNull())).alias("_x"))
    carried = carried.select(*keys, "_chunk", F.col("_x.n").alias("_no"), F.col("_x.v").alias(value), F.lit(True).alias("_carried"))
    both = placed.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    filled = both.withColumn(name, interpolate(value, ["_chunk", *keys], ["_no"], F.col("_no")))
    return filled.where("not _carried").drop("_no", "_chunk", "_carried")
