"""Joining facts to dimensions, by pivot and without making the wide join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.order import global_row_number, median_windows, misses_medians, quantiles_by, running_sums, weighted_quantiles_by, window_cells, window_share
from tabloom.operators.skew import FEW_KEYS, checked_join, dealt_join
from tabloom.sources.staging import staged


def unique_keys(dim: DataFrame, keys: Sequence[str]) -> None:
    """An error if a key repeats: the join would multiply facts."""
    if not dim.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"the dimension repeats values of {', '.join(keys)}")


def numbered_dimension(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds row_no by key order, in ranges."""
    return global_row_number(dim, *keys)


def merge_pivot(fact: DataFrame, dim: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds @M_{name}: the number of the dimension row that a fact joins, one past the last for facts that join none.

    Facts of a heavy key, and those with a null in theirs, are dealt out. An error if keys repeat or no fact joins.
    """
    unique_keys(dim, keys)
    numbered = staged(numbered_dimension(dim.select(*keys), keys))
    n = numbered.count()
    if fact.join(F.broadcast(numbered) if n <= FEW_KEYS else numbered, list(keys), "left_semi").isEmpty():
        raise ValueError("no fact joins the dimension")
    return checked_join(fact, numbered, keys).withColumn(f"@M_{name}", F.coalesce("row_no", F.lit(n)).cast("int")).drop("row_no")


def merged_histogram(fact: DataFrame, dim: DataFrame, keys: Sequence[str], target: str, edges: dict[str, Sequence[float]], name: str) -> DataFrame:
    """(desc, feature, bin, n, sum_y, sum_y2) of dimension features over the facts, as if joined.

    Facts are summed by key first (partial sums before the shuffle, so a hot key is one row a task); only those sums meet
    the dimension. A value's bin is the number of edges at or below it; null and unmatched facts have bin -1.
    """
    unique_keys(dim, keys)
    y = F.col(target)
    sums = fact.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_y2"))
    joined = sums.join(dim.select(*keys, *edges), list(keys), "left")
    cells = []
    for feature, cuts in edges.items():
        x = F.col(feature)
        at = sum((F.when(x >= c, 1).otherwise(0) for c in cuts), F.lit(0))
        cells.append(F.struct(F.lit(feature).alias("feature"), F.when(x.isNull(), -1).otherwise(at).alias("bin")))
    out = joined.select(F.explode(F.array(*cells)).alias("c"), "n", "sum_y", "sum_y2").groupBy("c.feature", "c.bin")
    return out.agg(*(F.sum(c).alias(c) for c in ("n", "sum_y", "sum_y2"))).withColumn("desc", F.lit(name))


def weighted_edges(fact: DataFrame, dim: DataFrame, keys: Sequence[str], feature: str, bins: int, rows: str | None = None) -> list[float]:
    """Quantile edges of a dimension feature over the facts, from counts by value: at most bins - 1. `rows` is how many facts a row of fact stands for."""
    counts = fact.groupBy(*keys).agg((F.sum(rows) if rows else F.count("*")).alias("n")).join(dim.select(*keys, feature), list(keys)).where(F.col(feature).isNotNull())
    by_value = counts.groupBy(feature).agg(F.sum("n").alias("_n"))
    below = running_sums(by_value, [feature], {"_below": "_n"})
    total = by_value.agg(F.sum("_n")).first()[0]
    places = [k / bins * ((total or 0) - 1) for k in range(1, bins)]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))}) if total else []
    hit = F.filter(F.array(*map(F.lit, ranks)), lambda r: (F.col("_below") <= r) & (r < F.col("_below") + F.col("_n")))
    at = {r["rank"]: float(r["v"]) for r in below.select(F.explode(hit).alias("rank"), F.col(feature).alias("v")).collect()} if ranks else {}  # 2 * bins rows at most
    return sorted({at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places if ranks})


def fit_group_stats(train: DataFrame, keys: Sequence[str], value: str, prefix: str, accuracy: int | None = None) -> DataFrame:
    """Mean and median of known values by key, named apart by the prefix.

    The exact median is found by ranks among the values of a window around it, which a sample places and a count checks, so
    neither a hot key nor many values are one task's work; `accuracy` takes an approximate one. Rows are summed up by key
    and value in one pass, on which both rest.
    """
    if accuracy is None:
        share = window_share(train.count())
        windows = median_windows(train.sample(share, seed=0), keys, value) if share else None
        cells = staged(window_cells(train, keys, value, windows))
        known = cells.where("_v is not null")
        if windows is not None and misses_medians(known, keys, ["_n"]):
            cells = staged(window_cells(train, keys, value))
            known = cells.where("_v is not null")
        means = cells.groupBy(*keys).agg((F.sum(F.col("_mean") * F.col("_n")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))).alias(f"{prefix}_mean"))
        found = weighted_quantiles_by(known, keys, "_v", ["_n"], [0.5]).withColumn("q", F.col("q")[0])
    else:
        means = train.groupBy(*keys).agg(F.avg(value).alias(f"{prefix}_mean"))
        found = quantiles_by(train, keys, value, [0.5], accuracy)
    medians = found.select(F.struct(*keys).alias("_g"), F.col("q")[0].alias(f"{prefix}_median"))
    return means.withColumn("_g", F.struct(*keys)).join(medians, "_g", "left").drop("_g")


def apply_group_stats(df: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return checked_join(df, fitted, keys)


def left_join(fact: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts with the columns of their dimension row, one row a key, null where there is none. A key may hold any share of the facts, or be null."""
    return dealt_join(fact, dim, keys)


def override_known(df: DataFrame, known: DataFrame, keys: Sequence[str], value: str, by: str) -> DataFrame:
    """Replaces value by the known one where there is one."""
    return left_join(df, known.select(*keys, by), keys).withColumn(value, F.coalesce(by, value)).drop(by)


