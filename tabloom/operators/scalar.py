"""Row-wise features: time parts, cycles, transforms and scaling. fit_* make one row, joined by broadcast."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.keys import BUCKETS, bucket
from tabloom.operators.order import first_place, numbers, quantiles
from tabloom.operators.skew import checked_join

#: Period of each time part's cycle, as the feature definition has them.
PERIODS = {"second": 86400, "minute": 1440, "hour": 24, "day": 30, "dayofweek": 7, "month": 12}


def time_parts(ts: str) -> dict[str, Column]:
    """Hour, and weekday with Monday as 0."""
    return {"hour": F.hour(ts), "weekday": F.weekday(ts)}


def cyclical(ts: str, periods: dict[str, int] = PERIODS) -> dict[str, Column]:
    """Sine and cosine of every time part."""
    part = {"second": F.second(ts), "minute": F.minute(ts), "hour": F.hour(ts), "day": F.dayofmonth(ts), "dayofweek": F.weekday(ts), "month": F.month(ts)}
    return {f"{k}_{n}": f(part[k] * (2 * math.pi / p)) for k, p in periods.items() for n, f in (("sin", F.sin), ("cos", F.cos))}


def unlog(c: str | Column) -> Column:
    """Inverse of log1p, 0 at least."""
    return F.greatest(F.expm1(c), F.lit(0.0))


def rounded(c: str | Column, n: int) -> Column:
    """c to n decimals in doubles, halves away from 0: nearest(c * 10^n) / 10^n, as SQL engines on doubles have it, and without the decimals by which Spark's own round goes."""
    x = F.col(c) if isinstance(c, str) else c
    scaled = x * float(10**n)
    nearest = F.rint(scaled)
    half = F.abs(scaled - F.rint(scaled)) == 0.5
    out = F.when(half, scaled + F.signum(scaled) * 0.5).otherwise(nearest) / float(10**n)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def clip(c: str, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)))


def weighted_sum(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def distance_to_center(df: DataFrame, centers: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Adds distance to the center (cx, cy) of the row's category; null without one."""
    out = checked_join(df, centers, [key])
    return out.withColumn("distance", F.sqrt(F.pow(F.col(x) - F.col("cx"), 2) + F.pow(F.col(y) - F.col("cy"), 2))).drop("cx", "cy")


def fill_odd(c: str, fill: float) -> Column:
    """NaN, infinite and null values become the fill value."""
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(fill)).otherwise(x)


def fit_boxcox(df: DataFrame, columns: Sequence[str], grid: Sequence[float], least_skew: float = 0.5) -> dict[str, float]:
    """Lambda of each column that is skewed over least_skew: the grid's value of the highest likelihood of 1 + x."""
    skews = df.agg(*(F.skewness(c).alias(c) for c in columns)).first()
    chosen = [c for c in columns if skews[c] is not None and skews[c] > least_skew]
    if not chosen:
        return {}
    terms = []
    for c in chosen:
        logs = F.log(1 + F.col(c))
        for k, lam in enumerate(grid):
            fit = boxcox(F.col(c), lam)
            terms.append((-F.count(c) / 2 * F.log(F.var_pop(fit)) + (lam - 1) * F.sum(logs)).alias(f"{c}:{k}"))
    row = df.agg(*terms).first()
    best = {}
    for c in chosen:
        likelihoods = [(row[f"{c}:{k}"], -k) for k in range(len(grid)) if row[f"{c}:{k}"] is not None]
        best[c] = grid[-max(likelihoods)[1]]
    return best


def boxcox(x: Column, lam: float) -> Column:
    return F.log1p(x) if lam == 0 else (F.pow(1 + x, F.lit(lam)) - 1) / lam


def scale_target(df: DataFrame, fitted: DataFrame, column: str, name: str) -> DataFrame:
    """Adds (y - mean) / deviation, for what fit_standard() returned for the column."""
    return df.crossJoin(F.broadcast(fitted)).withColumn(name, (F.col(column) - F.col(f"_m_{column}")) / F.col(f"_s_{column}")).drop(*fitted.columns)


def unscale_target(df: DataFrame, fitted: DataFrame, column: str, scaled: str, name: str) -> DataFrame:
    """Adds the inverse of scale_target()."""
    return df.crossJoin(F.broadcast(fitted)).withColumn(name, F.col(scaled) * F.col(f"_s_{column}") + F.col(f"_m_{column}")).drop(*fitted.columns)


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column; a deviation of 0 counts as 1."""
    std = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c))
    return df.agg(*(e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), std(c).alias(f"_s_{c}"))))


def fit_robust(df: DataFrame, columns: Sequence[str], accuracy: int | None = None, weight: str | None = None) -> DataFrame:
    """One row: median and quartile distance of each column; a distance of 0 counts as 1, a column without values is null."""
    found = quantiles(df, columns, [0.25, 0.5, 0.75], accuracy, weight)
    cells = {}
    for c in columns:
        low, mid, high = found.get(c, [None] * 3)
        cells |= {f"_m_{c}": mid, f"_s_{c}": None if low is None else (high - low) or 1.0}
    return df.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(n) for n, v in cells.items()))


def apply_scale(df: DataFrame, fitted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - center) / scale of each column, for what fit_standard() or fit_robust() return."""
    out = df.crossJoin(F.broadcast(fitted))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*fitted.columns)


# A published rational approximation of the normal quantile (relative error 1.2e-9), centre and tails.
_CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _polynomial(terms: Sequence[float], x: Column) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out * x + t
    return out


def normal_inverse(p: Column) -> Column:
    """Quantiles of the standard normal."""
    q = p - 0.5
    r = q * q
    centre = _polynomial(_CENTRE, r) * q / _polynomial(_CENTRE_BELOW, r)
    s = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(_TAIL, s) / _polynomial(_TAIL_BELOW, s)
    return F.when(F.abs(q) <= 0.5 - 0.02425, centre).when(q < 0, tail).otherwise(-tail)


def noise(key: str | Column, seed: int) -> Column:
    """A standard normal number from a hash of the seed and a key, equal on any partitioning."""
    return normal_inverse((bucket(key, seed) + 0.5) / BUCKETS)


def fit_quantiles(df: DataFrame, columns: Sequence[str], n: int = 1000, accuracy: int | None = None, noised: float = 0.0, seed: int = 0, key: str | None = None) -> dict[str, list[float]]:
    """n + 1 quantiles of each column. With `noised`, a column gets Gaussian noise of noised / max(deviation, noised) deviations first, which breaks plateaus.

    The noise follows a hash of each row's `key`, which it needs.
    """
    if noised:
        if key is None:
            raise ValueError("noise needs a key")
        std = df.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
        df = df.withColumns({c: F.col(c) + noised / max(std[c] or 0.0, noised) * noise(key, seed + k) for k, c in enumerate(columns)})
    return quantiles(df, columns, [k / n for k in range(n + 1)], accuracy)


def level_of(x: Column, edges: Sequence[float]) -> Column:
    """The share of rows below x by quantiles at equal steps: linear between two, the middle of a plateau where they repeat."""
    known, most = numbers(edges), len(edges)
    below, upto = first_place(most, lambda k: F.get(known, k) < x), first_place(most, lambda k: F.get(known, k) <= x)

    def between(at: Column) -> Column:
        lo, hi = F.get(known, at["upto"] - 1), F.get(known, at["upto"])
        step = at["upto"] - 1 + (x - lo) / (hi - lo)
        return F.when(at["below"] < at["upto"], (at["below"] + at["upto"] - 1) / 2).when(at["upto"] == 0, 0.0).when(at["upto"] == most, most - 1.0).otherwise(step) / (most - 1)

    # Each search is made once: its place is the element of an array that the rest is a function of.
    return F.get(F.transform(F.array(F.struct(below.alias("below"), upto.alias("upto"))), between), 0)


def quantile_normal(df: DataFrame, fitted: dict[str, list[float]], edge: float = 1e-7) -> DataFrame:
    """Maps columns to normal scores by their quantiles, two at least. Null stays null."""
    level = {f"_p_{c}": F.least(F.greatest(level_of(F.col(c).cast("double"), q), F.lit(edge)), F.lit(1 - edge)) for c, q in fitted.items()}
    leveled = df.withColumns(level)
    return leveled.withColumns({c: F.when(F.col(c).isNotNull(), normal_inverse(F.col(f"_p_{c}"))) for c in fitted}).drop(*level)
