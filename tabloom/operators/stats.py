"""Aggregates, profiles, bins and histograms. Many columns take one pass; many features one grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.encode import apply_levels
from tabloom.operators.order import held, quantiles_by, weighted_quantiles_by
from tabloom.operators.skew import dealt_join


def group_encode(df: DataFrame, key: str, values: Sequence[str], missing: float = -1.0) -> DataFrame:
    """Adds {value}_{key}_mean and _std over all rows of df, one grouping for a key; a sentinel `missing` is null before, and null is `missing` after.

    A null key is no group: its rows get `missing`. Rows of a heavy key, and those with a null one, are dealt out in the join.
    """
    known = {v: F.nullif(F.col(v), F.lit(missing)) for v in values}
    made = [f(c).alias(f"{v}_{key}_{n}") for v, c in known.items() for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    out = dealt_join(df, df.groupBy(key).agg(*made, F.count("*").alias("_rows")), [key], rows="_rows")
    return out.withColumns({f"{v}_{key}_{n}": F.coalesce(f"{v}_{key}_{n}", F.lit(missing)) for v in values for n in ("mean", "std")})


def group_encode_all(df: DataFrame, keys: Sequence[str], values: Sequence[str], missing: float = -1.0, row_key: str | None = None) -> DataFrame:
    """What group_encode() adds, for several keys: one pass fits all of them, and apply_levels() brings the values back."""
    known = [F.nullif(F.col(v), F.lit(missing)).alias(f"_v{i}") for i, v in enumerate(values)]
    cells = df.select(*known, F.inline(F.array(*(F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("level")) for k in keys)))).where("level is not null")
    made = [f(f"_v{i}").alias(f"{n}{i}") for i in range(len(values)) for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    fitted = cells.groupBy("column", "level").agg(*made, F.count("*").alias("_rows"))
    names = {k: {f"{n}{i}": f"{v}_{k}_{n}" for i, v in enumerate(values) for n in ("mean", "std")} for k in keys}
    out = apply_levels(df, fitted, names, row_key)
    return out.withColumns({n: F.coalesce(n, F.lit(missing)) for of in names.values() for n in of.values()})


def nunique_encode(df: DataFrame, key: str, value: str, error: float | None = None) -> DataFrame:
    """Adds {key}_{value}_ct: distinct known values by key; null for keys without any. Distinct pairs are made first, so a hot key is dealt out.

    With `error`, the relative standard deviation, counts are approximate sketches that merge before they are shuffled.
    """
    known = df.where(F.col(value).isNotNull())
    if error is not None:
        counts = known.groupBy(key).agg(F.approx_count_distinct(value, error).alias(f"{key}_{value}_ct"), F.count("*").alias("_rows"))
    else:
        pairs = known.groupBy(key, value).agg(F.count("*").alias("_n"))
        counts = pairs.groupBy(key).agg(F.count("*").alias(f"{key}_{value}_ct"), F.sum("_n").alias("_rows"))
    return dealt_join(df, counts, [key], rows="_rows")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of known values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def tall(df: DataFrame, made: dict[str, dict[str, Column]]) -> DataFrame:
    """One row for each column of aggregates that one pass makes: (column, names...)."""
    row = df.agg(*(c.alias(f"{k}\u0001{n}") for k, cells in made.items() for n, c in cells.items()))
    cells = [F.struct(F.lit(k).alias("column"), *(F.col(f"`{k}\u0001{n}`").alias(n) for n in names)) for k, names in made.items()]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def null_counts(df: DataFrame) -> DataFrame:
    return tall(df, {c: {"nulls": F.sum(F.col(c).isNull().cast("bigint"))} for c in df.columns})


def column_skew(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, skew): population skewness."""
    return tall(df, {c: {"skew": F.skewness(c)} for c in columns})


def column_profile(df: DataFrame, categorical: Sequence[str] = ()) -> DataFrame:
    """(column, type, kind, lo, hi); lo and hi are those of numbers."""
    made = {}
    for c, t in df.dtypes:
        number = t in ("tinyint", "smallint", "int", "bigint", "float", "double")
        x = F.col(c).cast("double") if number else F.lit(None).cast("double")
        kind = "category" if c in categorical or t == "string" else "number" if number else "other"
        made[c] = {"type": F.max(F.lit(t)), "kind": F.max(F.lit(kind)), "lo": F.min(x), "hi": F.max(x)}
    return tall(df, made)


def unique_flag(df: DataFrame, key: str, columns: Sequence[str], want: int = 2) -> DataFrame:
    """(key, flag): 1 where exactly `want` columns hold a value that occurs once in its column."""
    cells = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(key, "x.*")
    once = cells.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n = 1")
    counts = once.groupBy(key).agg(F.count("*").alias("n"))
    return df.select(key).join(counts, key, "left").select(key, F.coalesce(F.col("n") == want, F.lit(False)).cast("int").alias("flag"))


def class_histogram(df: DataFrame, value: str, label: str, bins: Sequence[int]) -> DataFrame:
    """(bins, class, bin, n, density) over equal bins between the ends of all classes; the last is closed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("bins")
    spread = df.where(F.col(value).isNotNull()).select(F.col(label).alias("class"), F.col(value).alias("_x"), F.explode(F.array(*map(F.lit, bins))).alias("bins")).crossJoin(F.broadcast(ends))
    at = F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.col("bins") - 1)
    counts = spread.groupBy("bins", "class", at.cast("int").alias("bin"), width.alias("_w")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("bins", "class").agg(F.sum("n").alias("_t"))
    return counts.join(totals, ["bins", "class"]).select("bins", "class", "bin", "n", (F.col("n") / (F.col("_t") * F.col("_w"))).alias("density"))


def fit_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), least: float = 1e-7) -> DataFrame:
    """(keys, n, slope, intercept): null where fewer than two points or next to no variance of x make no line."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    out = df.groupBy(*keys).agg(F.count(F.when(both, 1)).alias("n"), F.avg(a).alias("_mx"), F.avg(b).alias("_my"), F.var_pop(a).alias("_vx"), F.covar_pop(a, b).alias("_c"))
    slope = F.when((F.col("n") >= 2) & (F.col("_vx") * F.col("n") >= least), F.col("_c") / F.nullif(F.col("_vx"), F.lit(0.0)))
    return out.select(*keys, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"))


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1 to `bins`: right-closed equal bins, the lowest edge in the first."""
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((x - lo) * bins / F.nullif(hi - lo, F.lit(0.0)))))).cast("int")


def fit_bins(df: DataFrame, columns: Sequence[str], max_bin: int = 256, accuracy: int | None = None, mode: str = "quantile") -> dict[str, list[float]]:
    """Edges for each column: its values, if they are few, else distinct quantiles. All columns share a pass.

    In mode "quantile" there are max_bin - 1 edges at most, at equal counts of rows. In mode "frequency" a value with more
    than a bin's share of the known rows (1 / max_bin, so they are fewer than max_bin) has a bin of its own, and the other
    rows are cut to equal counts in the bins that are left, one at least; a bin of these that spans such a value is in two.
    """
    if mode not in ("quantile", "frequency"):
        raise ValueError(f"unknown mode {mode}")
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns)))).where("x is not null")
    with held(cells.groupBy("column", "x").agg(F.count("*").alias("n"))) as values:
        return _edges(cells, values, columns, max_bin, accuracy, mode)


def _edges(cells: DataFrame, values: DataFrame, columns: Sequence[str], max_bin: int, accuracy: int | None, mode: str) -> dict[str, list[float]]:
    per = values.groupBy("column").agg(F.count("*").alias("values"), F.sum("n").alias("total"))  # a row for each column
    known = values.join(F.broadcast(per), "column")
    own = F.col("n") * max_bin > F.col("total") if mode == "frequency" else F.lit(False)
    few = known.where((F.col("values") <= max_bin) | own).groupBy("column").agg(F.first("values").alias("values"), F.sort_array(F.collect_list("x")).alias("x"))
    out: dict[str, list[float]] = {c: [] for c in columns}
    heavy: dict[str, list[float]] = {}
    for r in few.collect():  # max_bin values of each column at most
        if r["values"] <= max_bin:
            out[r["column"]] = list(r["x"])[1:]
            heavy[r["column"]] = []
        else:
            heavy[r["column"]] = list(r["x"])
    several = [c for c in columns if not (c in heavy and not heavy[c])]
    if not several:
        return out
    # Columns that keep as many quantiles are cut together, from the counts by value.
    by_bins: dict[int, list[str]] = {}
    for c in several:
        by_bins.setdefault(max(1, max_bin - len(heavy.get(c, []))), []).append(c)
    for bins, some in by_bins.items():
        levels = [k / bins for k in range(1, bins)]
        rest = known.where(F.col("column").isin(some) & ~own)
        if accuracy is not None:
            plain = cells.where(F.col("column").isin(some)).join(F.broadcast(known.where(own).select("column", "x")), ["column", "x"], "left_anti") if mode == "frequency" else cells.where(F.col("column").isin(some))
            found = {r["column"]: r["q"] for r in quantiles_by(plain, ["column"], "x", levels, accuracy).collect()} if levels else {}
        else:
            found = {r["column"]: r["q"][0] or [] for r in weighted_quantiles_by(rest, ["column"], "x", ["n"], levels).collect()} if levels else {}
        for c in some:
            out[c] = sorted({*found.get(c, []), *(e for v in heavy.get(c, []) for e in (v, math.nextafter(v, math.inf)))})
    return out


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at or below the value: a binary search over a constant array; -1 for null."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= edges[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return F.when(x.isNull(), F.lit(-1)).otherwise(search(0, len(edges)))


def bin_target_stats(df: DataFrame, edges: dict[str, Sequence[float]], target: str) -> DataFrame:
    """(feature, bin, n, sum_y, sum_y2) of all features; a bin is what bin_of() gives, and bins without rows are left out.

    Each task keeps dense counters of every feature and bin and gives them at its end, so rows are not taken once for each
    feature, and what is shuffled depends on features, bins and tasks alone. Rows without a target count nowhere.
    """
    names, widest = list(edges), max(map(len, edges.values()), default=0) + 2
    cuts = [np.asarray(e, float) for e in edges.values()]
    fields = ["feature", "bin", "n", "sum_y", "sum_y2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, len(cuts), widest))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for k, cut in enumerate(cuts):
                x = b.column(k + 1)
                there = x.is_valid().to_numpy(zero_copy_only=False)
                at = np.where(there, np.searchsorted(cut, x.fill_null(0.0).to_numpy(zero_copy_only=False), "right") + 1, 0)
                for total, weight in zip(held, (None, y, y * y), strict=True):
                    total[k] += np.bincount(at, weight, widest)
        feature, bin_ = np.nonzero(held[0])
        columns = [pa.array(feature, pa.int32()), pa.array(bin_ - 1, pa.int32()), pa.array(held[0][feature, bin_].astype(np.int64)), *(pa.array(h[feature, bin_]) for h in held[1:])]
        yield pa.RecordBatch.from_arrays(columns, fields)

    rows = df.where(F.col(target).isNotNull()).select(F.col(target).cast("double"), *(F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(names)))
    counted = rows.mapInArrow(run, "feature int, bin int, n bigint, sum_y double, sum_y2 double").groupBy("feature", "bin")
    named = counted.agg(*(F.sum(c).alias(c) for c in fields[2:]))
    return named.withColumn("feature", F.get(F.array(*map(F.lit, names)), F.col("feature")))


def best_split(binned: DataFrame, least: int = 20) -> DataFrame:
    """(feature, bin, gain): the split "up to bin" of the greatest drop of squared error, both sides with `least` rows."""
    up, all_ = Window.partitionBy("feature").orderBy("bin"), Window.partitionBy("feature")
    run = binned.select("feature", "bin", F.sum("n").over(up).alias("ln"), F.sum("sum_y").over(up).alias("ls"), F.sum("n").over(all_).alias("tn"), F.sum("sum_y").over(all_).alias("ts"))
    rn, rs = F.col("tn") - F.col("ln"), F.col("ts") - F.col("ls")
    gain = F.pow("ls", F.lit(2)) / F.col("ln") + F.pow(rs, F.lit(2)) / F.nullif(rn, F.lit(0)) - F.pow("ts", F.lit(2)) / F.col("tn")
    fit = run.where((F.col("ln") >= least) & (rn >= least)).withColumn("gain", gain)
    return fit.groupBy("feature").agg(F.max_by("bin", F.struct("gain", -F.col("bin"))).alias("bin"), F.max("gain").alias("gain"))


def top_importance(df: DataFrame, n: int = 32) -> DataFrame:
    """(feature, importance, weight) of the n highest means over folds above 0; the weight is the share of the highest."""
    means = df.groupBy("feature").agg(F.avg("importance").alias("importance")).where("importance > 0").orderBy(F.desc("importance"), "feature").limit(n)
    top = means.agg(F.max("importance").alias("_top"))
    return means.crossJoin(F.broadcast(top)).withColumn("weight", F.col("importance") / F.col("_top")).drop("_top")
