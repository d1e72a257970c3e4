"""Row numbers, running sums and exact quantiles over a whole order, in ranges: no task sorts more than a range.

Ranges are cut on the whole order by samples, taken by a hash of the order's values, so a first column with few values is
cut by the columns after it. Edges are a search tree: each level cuts every range of the level above in FANOUT at most, a
row finds its place by a binary search, and there are as many levels as the rows need. Rows that are equal in all of the
order share a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.skew import dealt_join

#: Rows in one range, on average, and ranges that one level of edges makes of one range.
RANGE_ROWS, FANOUT = 200_000, 1024
#: Sampled rows for each range.
SAMPLED = 32


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df, cached while it is read over and over, and let go after."""
    try:
        yield df.cache()
    finally:
        df.unpersist()


def _struct(order: Sequence[str | Column]) -> Column:
    return F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"k{i}") for i, o in enumerate(order)))


def first_place(most: int, passed: Callable[[Column], Column]) -> Column:
    """How many of up to `most` places are passed, where all passed ones come first: a binary search by falling powers of two."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, by: F.when(passed(at + by - 1), at + by).otherwise(at))


def place_among(edges: Column, x: Column, most: int) -> Column:
    """How many of up to `most` sorted edges lie below x."""
    return first_place(most, lambda at: F.get(edges, at) < x)


def _cut(sample: Column, parts: int) -> Column:
    """parts - 1 elements of a sorted sample, evenly spaced."""
    return F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get(sample, F.floor(i * F.size(sample) / parts).cast("int")))


def in_ranges(df: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Adds _k, the order's values, and _range. `parts` is from a count of the rows where it is not given."""
    keyed = df.withColumn("_k", _struct(order))
    n = None
    if parts is None:
        n = df.count()
        parts = n // RANGE_ROWS + 1
    if parts <= 1:
        return keyed.withColumn("_range", F.lit(0).cast("bigint"))
    made = min(parts, FANOUT)
    sample = keyed.select("_k").orderBy(F.xxhash64("_k"), "_k").limit(made * SAMPLED)
    edges = sample.agg(_cut(F.sort_array(F.collect_list("_k")), made).alias("_edges"))  # one row of FANOUT edges at most
    out = keyed.crossJoin(F.broadcast(edges)).withColumn("_range", place_among(F.col("_edges"), F.col("_k"), made - 1).cast("bigint")).drop("_edges")
    n = n if n is not None or made == parts else df.count()
    while made < parts:
        # A further level: each range has edges of its own, copied for each share of its rows, to which the rows are dealt.
        cut = min(FANOUT, -(-parts // made))
        sampled = out.where(F.pmod(F.xxhash64("_k", F.lit(made)), F.lit(max(1, n // (made * cut * SAMPLED)))) == 0)
        edges = sampled.groupBy("_range").agg(_cut(F.sort_array(F.collect_list("_k")), cut).alias("_edges"))
        rows = out.groupBy("_range").agg(F.count("*").alias("_rows"))
        out = dealt_join(out, rows.join(edges, "_range", "left"), ["_range"], "inner", "_rows")
        place = F.coalesce(place_among(F.col("_edges"), F.col("_k"), cut - 1), F.lit(0))
        out = out.withColumn("_range", F.col("_range") * FANOUT + place).drop("_edges")
        made *= cut
    return out


def _before(totals: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(_range, _b_...): for each range the sums of all earlier ones. Ranges are summed level by level, so that a window holds FANOUT of them."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    block = totals.withColumn("_block", F.floor(F.col("_range") / FANOUT))
    inner = Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each FANOUT ranges
    blocks = block.groupBy("_block").agg(*(F.sum(c).alias(f"_w_{c}") for c in sums)).select("_block", *(zero(F.sum(f"_w_{c}").over(outer)).alias(f"_w_{c}") for c in sums))
    return block.join(blocks, "_block").select("_range", *((zero(F.sum(c).over(inner)) + F.col(f"_w_{c}")).alias(f"_b_{c}") for c in sums))


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Adds for each name the sum of its column over all rows before a row in the order, which should tell rows apart."""
    ranged = in_ranges(df, order, parts)
    before = _before(ranged.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items())), [f"_{n}" for n in sums])
    own = Window.partitionBy("_range").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    # Both sides are dealt by range, as the window wants them; Spark broadcasts the few rows where their size allows.
    joined = ranged.join(before, "_range")
    return joined.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"_b__{n}") for n, c in sums.items()}).drop("_range", "_k", *(f"_b__{n}" for n in sums))


def global_row_number(df: DataFrame, *order: str | Column, parts: int | None = None, name: str = "row_no") -> DataFrame:
    """Adds a 0-based number in the given order; rows equal in all of it are numbered in any order."""
    ranged = in_ranges(df, order, parts)
    before = _before(ranged.groupBy("_range").agg(F.count("*").alias("_n")), ["_n"])
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_k")) - 1
    return ranged.join(before, "_range").withColumn(name, (own + F.col("_b__n")).cast("bigint")).drop("_range", "_b__n", "_k")


def numbers(values: Sequence[float]) -> Column:
    """A constant array of doubles, as one literal however many there are."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _asked(i: int, places: Sequence[int]) -> Column:
    """The quantiles of one weight in the order asked for; null if it has none."""
    own = F.transform(F.filter("_q", lambda x: x["i"] == i), lambda x: x["x"])
    if list(places) != list(range(len(places))):
        own = F.transform(F.lit(list(places)), lambda k: F.get(own, k))
    return F.when(F.size(F.filter("_q", lambda x: x["i"] == i)) > 0, own)


#: Levels of all weights together that are compared one by one.
FEW_RANKS = 64


def _holds(i: int, level: float, whole: Callable[[Column], Column]) -> Column:
    """Does a cell hold the rank of a level, by the i-th weight."""
    rank, at = whole(F.lit(level) * (F.col(f"_n{i}") - 1)), F.col(f"_below{i}") - F.col(f"_start{i}")
    return (F.col(f"_n{i}") > 0) & (at <= rank) & (rank < at + F.col(f"_w{i}"))


def weighted_quantiles_by(cells: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """(keys, q array<array<double>>): for each weight in turn, the quantiles by key of values that count as often as it says.

    cells has one row for each key and value, a double. Ranks are found by running sums, one for each weight: by key where
    a count finds no key of more cells than a range has, else in ranges, so neither a hot key nor many values are one task's work. Linear between neighbours; null where a weight sums to 0.
    """
    marked = cells.select(F.struct(*(F.col(k) for k in keys), F.lit(0).alias("_one")).alias("_g"), F.col(value).alias("_v"), *(F.col(w).alias(f"_w{i}") for i, w in enumerate(weights)))
    if longest(marked, ["_g"]) <= RANGE_ROWS:
        # No key has more cells than a range: no whole order is needed.
        key = Window.partitionBy("_g")
        own = key.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        met = marked.withColumns({n: c for i in range(len(weights)) for n, c in ((f"_below{i}", F.coalesce(F.sum(f"_w{i}").over(own), F.lit(0))), (f"_n{i}", F.sum(f"_w{i}").over(key)), (f"_start{i}", F.lit(0)))})
    else:
        summed = running_sums(marked, ["_g", "_v"], {f"_below{i}": f"_w{i}" for i in range(len(weights))})
        sums = [e for i in range(len(weights)) for e in (F.sum(f"_w{i}").alias(f"_n{i}"), F.min(f"_below{i}").alias(f"_start{i}"))]
        met = dealt_join(summed, summed.groupBy("_g").agg(*sums), ["_g"], "inner", counts=marked.groupBy("_g").agg(F.count("*").alias("_rows")))
    if len(weights) * len(levels) <= FEW_RANKS:
        # Few cells hold a rank that is asked for: plain comparisons leave the others out.
        met = met.where(reduce(Column.__or__, (_holds(i, p, up) for i in range(len(weights)) for p in levels for up in (F.floor, F.ceil))))
    # The levels whose lower, or upper, rank is one of a cell's ranks [at, at + c) follow one another: two binary searches each.
    ordered = sorted(levels)
    known, most, hits = numbers(ordered), len(ordered), []
    for i in range(len(weights)):
        at, n, c = F.col(f"_below{i}") - F.col(f"_start{i}"), F.col(f"_n{i}"), F.col(f"_w{i}")
        place = lambda k: F.get(known, k) * (n - 1)  # noqa: B023, E731
        for upper in (False, True):
            low, high = (first_place(most, lambda k, x=x: place(k) <= x - 1 if upper else place(k) < x) for x in (at, at + c))  # noqa: B023
            told = F.transform(F.sequence(low, high - 1), lambda k: F.struct(F.lit(i).alias("i"), k.alias("k"), F.lit(upper).alias("upper"), (place(k) - F.floor(place(k))).alias("w")))  # noqa: B023
            hits.append(F.when((n > 0) & (c > 0) & (high > low), told).otherwise(F.array().cast("array<struct<i:int,k:int,upper:boolean,w:double>>")))
    found = met.withColumn("_h", F.explode(F.concat(*hits)))
    ends = found.groupBy("_g", "_h.i", "_h.k").agg(F.max(F.when(~F.col("_h.upper"), F.col("_v"))).alias("lo"), F.max(F.when(F.col("_h.upper"), F.col("_v"))).alias("hi"), F.max("_h.w").alias("w"))
    between = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - F.col("w")) * F.col("lo") + F.col("w") * F.col("hi"))
    rows = ends.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("i", "k", between.alias("x")))).alias("_q"))
    of = F.array(*(_asked(i, [ordered.index(p) for p in levels]) for i in range(len(weights))))
    return rows.select(*(F.col(f"_g.{k}").alias(k) for k in keys), of.alias("q"))


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """(keys, q array<double>): quantiles of known values by key, linear between neighbours.

    Exact ones count rows by value first, with partial sums, and find the ranks by weighted_quantiles_by(). With
    `accuracy` they are approximate (an element of the column whose rank is within n / accuracy), from one pass.
    """
    known = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    if accuracy is not None:
        return known.groupBy(*keys).agg(F.percentile_approx("_v", F.lit(list(levels)), accuracy).alias("q"))
    cells = known.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    return weighted_quantiles_by(cells, keys, "_v", ["_c"], levels).select(*keys, F.col("q")[0].alias("q"))


#: Rows of a sample that says where medians are about, on average.
WINDOW_ROWS = 4_000_000
#: (width, sampled rows of a key that it takes): a window holds the ranks from width below the middle to width above, as shares, which are five deviations of a sample's median.
WIDTHS = ((0.005, 250_000), (0.01, 62_500), (0.02, 15_625), (0.05, 2500), (0.1, 625))


def window_share(n: int) -> float | None:
    """The share of n rows that median_windows() should see; None where every value may be a cell."""
    return min(1.0, WINDOW_ROWS / n) if n > RANGE_ROWS else None


def median_windows(sample: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _lo, _hi): a key's median most likely lies between these, by a sample of its rows; keys with few sampled rows are left out, so there are few."""
    at = sorted({0.5 + side * width for width, _ in WIDTHS for side in (-1, 1)})
    found = sample.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile_approx(value, F.lit(at), 10_000).alias("_q"), F.count("*").alias("_m"))
    ends = {n: F.coalesce(*(F.when(F.col("_m") >= m, F.get("_q", F.lit(at.index(0.5 + side * width)))) for width, m in WIDTHS)) for n, side in (("_lo", -1), ("_hi", 1))}
    return found.where(F.col("_m") >= WIDTHS[-1][1]).select(*keys, *(c.alias(n) for n, c in ends.items()))


def window_cells(df: DataFrame, keys: Sequence[str], value: str, windows: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(keys, by, _side, _v, _n, _mean, _var): rows, mean and variance of each value of a key; but the values below its window are one cell (_side -1, _v -inf), and those above it another (1, inf).

    Without windows, and for keys that have none, every value is a cell. Medians that lie in their windows, which
    misses_medians() tells, are exact from cells, and so are sums.
    """
    x = F.col(value).cast("double")
    if windows is None:
        met, side = df, F.lit(0)
    else:
        met, side = df.join(F.broadcast(windows), list(keys), "left"), F.when(x < F.col("_lo"), -1).when(x > F.col("_hi"), 1).otherwise(0)  # few, as each has its share of a sample
    told = met.select(*keys, *by, x.alias("_x"), side.alias("_side")).withColumn("_v", F.when(F.col("_side") == 0, F.col("_x")).otherwise(F.col("_side") * float("inf")))
    cells = told.groupBy(*keys, *by, "_side", "_v").agg(F.count("*").alias("_n"), F.avg("_x").alias("_mean"), F.var_pop("_x").alias("_var"))
    own = F.col("_side") == 0
    return cells.withColumns({"_mean": F.when(own, F.col("_v")).otherwise(F.col("_mean")), "_var": F.when(own, 0.0).otherwise(F.col("_var"))})


def misses_medians(cells: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> bool:
    """Does a key's median, by one of the weights, lie out of its window? Cells of unknown values are to be left out."""
    sums = [F.sum(F.when(when, F.col(w))).alias(f"{n}{i}") for i, w in enumerate(weights) for n, when in (("_b", F.col("_side") < 0), ("_a", F.col("_side") > 0), ("_n", F.lit(True)))]
    place = lambda i: (F.col(f"_n{i}") - 1) / 2
    above = lambda i: F.col(f"_n{i}") - F.coalesce(f"_a{i}", F.lit(0))
    missed = ((F.col(f"_n{i}") > 0) & ((F.floor(place(i)) < F.coalesce(f"_b{i}", F.lit(0))) | (F.ceil(place(i)) >= above(i))) for i in range(len(weights)))
    return not cells.groupBy(*keys).agg(*sums).where(reduce(Column.__or__, missed)).isEmpty()


#: Rows of one key in one chunk of chunked().
CHUNK_ROWS = 200_000


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Adds _no, the row's number in the order of (keys, order), and _chunk: that of `rows` rows in a row, all of the same size."""
    return global_row_number(df, *keys, *order, name="_no").withColumn("_chunk", F.floor(F.col("_no") / (rows or CHUNK_ROWS)))


def longest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float], accuracy: int | None = None, weight: str | None = None) -> dict[str, list[float]]:
    """Quantiles of several columns; a column without known values is left out. All columns share one pass.

    `weight` is a column that says how many rows a row stands for, in whole numbers for each value of a column; these are exact.
    """
    if weight and accuracy is not None:
        raise ValueError("quantiles of weights are exact")
    cells = df.select(*([F.col(weight).alias("_w")] if weight else []), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))))
    if accuracy is not None:
        return {r["column"]: list(r["q"]) for r in quantiles_by(cells, ["column"], "x", levels, accuracy).collect()}
    with held(cells.where("x is not null").groupBy("column", "x").agg((F.round(F.sum("_w")).cast("bigint") if weight else F.count("*")).alias("n"))) as counts:
        return {r["column"]: list(r["q"][0]) for r in weighted_quantiles_by(counts, ["column"], "x", ["n"], levels).collect()}
