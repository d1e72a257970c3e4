"""The readings job: join, grouped statistics, folds and errors. fold_scores() is the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.keys import bucket
from tabloom.jobs.registry import query, read
from tabloom.operators import merge
from tabloom.operators.order import median_windows, misses_medians, weighted_quantiles_by, window_cells, window_share
from tabloom.sources.staging import staged

FOLDS = 5


def joined_readings(spark, d):
    """Lines with a meter, and their order's month and fold: the reading is the log of the price, the meter the return flag. Lines of no order have no month."""
    orders = read(spark, d, "orders").where("o_orderkey is not null and o_orderdate is not null")
    dated = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.month("o_orderdate").alias("month"), (bucket("o_orderkey") % FOLDS).cast("int").alias("fold"))
    fact = read(spark, d, "lineitem").where("l_returnflag is not null")
    return fact.select("l_orderkey", F.col("l_returnflag").alias("meter"), F.log1p("l_extendedprice").alias("y")).join(dated.hint("shuffle_hash"), "l_orderkey")


@query("fold_scores", """
with r as (select l_returnflag as meter, ln(1 + l_extendedprice) as y, month(o_orderdate) as month, o_orderpriority,
    (('0x'||substr(md5('0:'||l_orderkey::varchar),1,8))::bigint % 5)::int as fold
  from lineitem left join orders on l_orderkey = o_orderkey),
p as (select t.round, r.meter, r.month, avg(y) as m, median(y) as md from r, range(5) t(round) where fold <> t.round group by all)
select fold, count(*) as n, round(sqrt(avg((y - m) * (y - m))), 6) as rmse, round(avg(abs(y - md)), 6) as mae
from r join p on p.round = fold and p.meter = r.meter and p.month = r.month group by fold""")
def fold_scores(spark, d):
    """Errors by fold of the group mean and median that are fitted on the other folds.

    Rows are summed up once, by group, fold and value, where values far from the group's median, as a sample of orders
    places it, are one cell below and one above; what the other folds hold is all less their own, so no row is taken once
    for each round. The medians are exact, from ranks of a weight for each fold; if one is not in its group's window, every
    value becomes a cell. Errors come from the cells' means and variances, so facts are read and joined once, but for the
    sample's share, and do not meet the fits.
    """
    r, keys, rounds = joined_readings(spark, d), ["meter", "month"], range(FOLDS)
    share = window_share(read(spark, d, "lineitem").count())
    windows = median_windows(r.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(int(1 / share))) == 0), keys, "y") if share else None
    cells, values = fold_cells(r, windows)
    if windows is not None and misses_medians(values, keys, [f"n{k}" for k in rounds]):
        cells, values = fold_cells(r, None)
    rest = lambda k, x: F.sum(F.when(F.col("fold") != k, x))
    total, known = F.col("_mean") * F.col("_n"), F.when(F.col("_mean").isNotNull(), F.col("_n"))
    means = cells.groupBy(*keys).agg(*(c for k in rounds for c in ((F.coalesce(rest(k, F.col("_n")), F.lit(0)) > 0).alias(f"has{k}"), (rest(k, total) / F.nullif(rest(k, known), F.lit(0))).alias(f"m{k}"))))
    fitted = means.join(weighted_quantiles_by(values, keys, "_v", [f"n{k}" for k in rounds], [0.5]), keys, "left")
    at = lambda name: F.get(F.array(*(F.col(f"{name}{k}") for k in rounds)), F.col("fold"))
    met = merge.apply_group_stats(cells, fitted, keys).where(at("has"))  # a group that only its own fold has is predicted by none
    e, median = F.col("_mean") - at("m"), F.get(F.get("q", F.col("fold")), F.lit(0))
    square, distance = F.col("_var") + e * e, F.when(F.col("_side") == 0, F.abs(F.col("_v") - median)).otherwise((F.col("_mean") - median) * F.col("_side"))
    mean = lambda x: F.sum(x * F.col("_n")) / F.sum(F.when(x.isNotNull(), F.col("_n")))
    return met.groupBy("fold").agg(F.sum("_n").alias("n"), F.round(F.sqrt(mean(square)), 6).alias("rmse"), F.round(mean(distance), 6).alias("mae"))


def fold_cells(r, windows):
    """Cells of readings by group, fold and value, and, of the known ones, (meter, month, _side, _v, n0, n1, ...): rows of the other folds."""
    cells = staged(window_cells(r, ["meter", "month"], "y", windows, by=["fold"]))
    others = (F.sum(F.when(F.col("fold") != k, F.col("_n")).otherwise(0)).alias(f"n{k}") for k in range(FOLDS))
    return cells, staged(cells.where("_v is not null").groupBy("meter", "month", "_side", "_v").agg(*others))
