"""The readings job to its end: weather with gaps filled and lags, its number in every reading, and the rows to predict.

Orders play the weather: a site is a priority, a day's air the log of the mean price of its orders, unknown on every fifth
day. What a meter reads is planted: the quantity by a factor of the meter, half as much again at weekends, and a part of
the air.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.jobs.registry import query, read
from tabloom.operators import impute, merge, skew, windows
from tabloom.sources.staging import staged

#: Window lengths of the lags, in days that a site has.
LAGS = (3, 18)
#: Decimals of the weather's columns.
ROUNDED = {"air": 6} | {f"air_{s}_{n}": d for n in LAGS for s, d in (("mean", 6), ("median", 6), ("min", 6), ("max", 6), ("std", 5))}
WEATHER = [*ROUNDED, "n_orders"]

_LAGGED = ", ".join(
    f"round(avg(air) over w{n}, 6) as air_mean_{n}, round(quantile_cont(air, 0.5) over w{n}, 6) as air_median_{n}, round(min(air) over w{n}, 6) as air_min_{n}, round(max(air) over w{n}, 6) as air_max_{n}, round(coalesce(stddev_samp(air) over w{n}, 0), 5) as air_std_{n}"
    for n in LAGS
)
_WEATHER = f"""
d as (select o_orderpriority as site, date_diff('day', date '1970-01-01', o_orderdate::date)::int as day, count(*) as n_orders, ln(1 + avg(o_totalprice)) as mean from orders where o_orderdate is not null group by all),
e as (select *, case when day % 5 <> 0 then mean end as v, row_number() over (partition by site order by day) as p from d),
f as (select *, last_value(case when v is not null then p end ignore nulls) over b as p0, first_value(case when v is not null then p end ignore nulls) over a as p1, last_value(v ignore nulls) over b as v0, first_value(v ignore nulls) over a as v1 from e
  window b as (partition by site order by p rows between unbounded preceding and current row), a as (partition by site order by p rows between current row and unbounded following)),
g as (select site, day, n_orders, coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1) as air from f),
weather as (select site, day, n_orders, round(air, 6) as air, {_LAGGED} from g window {", ".join(f"w{n} as (partition by site order by day rows between {n - 1} preceding and current row)" for n in LAGS)})"""


def weather(spark, d):
    """A row for each site and day: air without gaps, its lags, and the number of orders."""
    orders = read(spark, d, "orders").where("o_orderdate is not null")
    days = orders.groupBy(F.col("o_orderpriority").alias("site"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("day"))
    seen = days.agg(F.count("*").alias("n_orders"), F.log1p(F.avg("o_totalprice")).alias("_mean")).withColumn("_v", F.when(F.col("day") % 5 != 0, F.col("_mean"))).drop("_mean")
    filled = impute.add_interpolated(seen, "_v", ["site"], ["day"], "air").drop("_v")
    lagged = windows.add_rolling(filled, "air", ["site"], ["day"], LAGS)
    return lagged.select("site", "day", "n_orders", *(F.round(c, n).alias(c) for c, n in ROUNDED.items()))


@query("weather_features", f"with {_WEATHER} select * from weather")
def weather_features(spark, d):
    return weather(spark, d)


@query("meter_features", f"""
with {_WEATHER},
n as (select *, row_number() over (order by site, day) - 1 as no from weather),
l as (select l_orderkey, l_linenumber, l_returnflag as meter, l_quantity as quantity, o_orderpriority as site, date_diff('day', date '1970-01-01', o_orderdate::date)::int as day, month(o_orderdate)::int as month, (isodow(o_orderdate) - 1)::int as weekday
  from lineitem left join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, meter, quantity, month, weekday, coalesce(no, (select count(*) from weather))::int as weather_no, case when l_orderkey % 5 = 4 then 'test' else 'train' end as split,
  round(quantity * case meter when 'R' then 3 when 'A' then 2 else 1 end * case when weekday >= 5 then 1.5 else 1 end + 3 * coalesce(air, 0), 9) as reading
from l left join n on l.site = n.site and l.day = n.day""")
def meter_features(spark, d):
    return meters(spark, d, weather(spark, d))


def meters(spark, d, air):
    """Readings with time parts and the number of their weather row, one past the last where there is none; what they read is planted."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("site"), "o_orderdate")
    fact = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("meter"), F.col("l_quantity").alias("quantity"))
    dated = merge.left_join(fact, orders, ["l_orderkey"])
    timed = staged(dated.withColumns({"day": F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")), "month": F.month("o_orderdate"), "weekday": F.weekday("o_orderdate")}).drop("o_orderdate"))
    placed = merge.merge_pivot(timed, air, ["site", "day"], "weather").withColumnRenamed("@M_weather", "weather_no")
    numbered = merge.numbered_dimension(air.select("site", "day", "air"), ["site", "day"])
    told = skew.checked_join(placed, numbered.select(F.col("row_no").cast("int").alias("weather_no"), "air"), ["weather_no"])
    factor = F.when(F.col("meter") == "R", 3).when(F.col("meter") == "A", 2).otherwise(1)
    reading = F.col("quantity") * factor * F.when(F.col("weekday") >= 5, 1.5).otherwise(1.0) + 3 * F.coalesce("air", F.lit(0.0))
    split = F.when(F.col("l_orderkey") % 5 == 4, "test").otherwise("train")
    return told.select("l_orderkey", "l_linenumber", "meter", "quantity", "month", "weekday", "weather_no", split.alias("split"), F.round(reading, 9).alias("reading"))
