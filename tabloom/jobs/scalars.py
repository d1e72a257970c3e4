"""Queries of the row-wise features and of scaling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabloom.jobs.registry import query, read
from tabloom.operators import scalar


def rounded(columns: dict, n: int = 6):
    return [F.round(c, n).alias(k) for k, c in columns.items()]


@query("time_parts", "select event_id, hour(t)::int as hour, (isodow(t) - 1)::int as weekday from (select event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as t from events)")
def time_parts(spark, d):
    df = read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t")).withColumn("t", F.to_timestamp_ntz("t", F.lit("yyyy-MM-dd HH:mm:ss")))
    return df.select("event_id", *(c.alias(k) for k, c in scalar.time_parts("t").items()))


_PARTS = {"second": "second(ts)", "minute": "minute(ts)", "hour": "hour(ts)", "day": "day(ts)", "dayofweek": "(isodow(ts) - 1)", "month": "month(ts)"}


@query("cyclical_time", "select event_id, " + ", ".join(f"round({f}({v} * {2 * math.pi / scalar.PERIODS[k]!r}), 6) + 0.0 as {k}_{f}" for k, v in _PARTS.items() for f in ("sin", "cos")) + " from events")
def cyclical_time(spark, d):
    return read(spark, d, "events").select("event_id", *(F.round(c, 6).alias(k) + 0.0 for k, c in scalar.cyclical("ts").items())).toDF("event_id", *scalar.cyclical("ts"))


@query("log_target", "select o_orderkey, round(ln(1 + o_totalprice), 6) as y, round(greatest(exp(ln(1 + o_totalprice) - 10) - 1, 0), 4) as back, floor(round(greatest(exp(ln(1 + o_totalprice)) - 1, 0), 4))::bigint as whole from orders")
def log_target(spark, d):
    y = F.log1p("o_totalprice")
    return read(spark, d, "orders").select("o_orderkey", F.round(y, 6).alias("y"), F.round(scalar.unlog(y - 10), 4).alias("back"), F.floor(F.round(scalar.unlog(y), 4)).alias("whole"))


@query("clip_range", "select event_id, case when v is not null then least(greatest(v, 0.0), 20.0) end as v from (select event_id, case when event_id % 7 <> 0 then value - 10 end as v from events)")
def clip_range(spark, d):
    return read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") - 10).alias("v")).select("event_id", scalar.clip("v", 0.0, 20.0).alias("v"))


@query("row_sums", "select l_orderkey, l_linenumber, l_partkey, round(1.0 * l_quantity + 0.5 * l_discount + 0.25 * l_tax, 6) as total from lineitem")
def row_sums(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(scalar.weighted_sum({"l_quantity": 1.0, "l_discount": 0.5, "l_tax": 0.25}), 6).alias("total"))


@query("center_distance", "with c as (select l_returnflag, avg(l_quantity) as cx, avg(l_discount) as cy from lineitem where l_returnflag <> 'N' group by 1) select l_orderkey, l_linenumber, l_partkey, round(sqrt(pow(l_quantity - cx, 2) + pow(l_discount - cy, 2)), 6) as distance from lineitem left join c using (l_returnflag)")
def center_distance(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_discount")
    centers = df.where("l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.avg("l_quantity").alias("cx"), F.avg("l_discount").alias("cy"))
    return scalar.distance_to_center(df, centers, "l_returnflag", "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "l_partkey", F.round("distance", 6).alias("distance"))


@query("fill_nan_inf", "select event_id, case when event_id % 5 in (0, 1, 2, 3) then -1.0 else value end as v from events")
def fill_nan_inf(spark, d):
    k = F.col("event_id") % 5
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 4, F.col("value"))
    return read(spark, d, "events").select("event_id", v.alias("v")).select("event_id", scalar.fill_odd("v", -1.0).alias("v"))


GRID = (-1.0, -0.5, 0.0, 0.5, 1.0)
_BC = lambda x, lam: f"ln(1 + {x})" if lam == 0 else f"((pow(1 + {x}, {lam}) - 1) / {lam})"


@query("boxcox_skewed", "with l as (select k, lam, ll, row_number() over (order by ll desc, k) as r from (" + " union all ".join(f"select {k} as k, {lam} as lam, -count(*) / 2 * ln(var_pop({_BC('value', lam)})) + {lam - 1} * sum(ln(1 + value)) as ll from events" for k, lam in enumerate(GRID)) + ")) select event_id, round(case (select k from l where r = 1) " + " ".join(f"when {k} then {_BC('value', lam)}" for k, lam in enumerate(GRID)) + " end, 5) as value, round(user_id, 5)::double as even from (select event_id, value, user_id::double as user_id from events)")
def boxcox_skewed(spark, d):
    df = read(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double").alias("even"))
    fitted = scalar.fit_boxcox(df, ["value", "even"], GRID)
    return df.select("event_id", *(F.round(scalar.boxcox(F.col(c), fitted[c]) if c in fitted else F.col(c), 5).alias(c) for c in ("value", "even")))


@query("standardize", "with m as (select avg(l_quantity) as a, stddev_pop(l_quantity) as s from lineitem where l_orderkey % 5 <> 0) select l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / s, 6) as l_quantity, 0.0::double as one from lineitem, m")
def standardize(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.lit(1.0).alias("one"))
    out = scalar.apply_scale(df, scalar.fit_standard(df.where("l_orderkey % 5 <> 0"), ["l_quantity", "one"]), ["l_quantity", "one"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("l_quantity"), "one")


@query("robust_scale", "with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b, quantile_cont(value, 0.75) as c from events) select event_id, round((value - b) / (c - a), 6) as value from events, q")
def robust_scale(spark, d):
    df = read(spark, d, "events").select("event_id", "value")
    return scalar.apply_scale(df, scalar.fit_robust(df, ["value"]), ["value"]).select("event_id", F.round("value", 6).alias("value"))


def _horner(terms, x):
    out = "0.0"
    for t in terms:
        out = f"({out} * {x} + {t!r})"
    return out


@query("quantile_normal", f"""
with q as (select quantile_cont(value, [k / 1000.0 for k in range(1001)]) as q from events where event_id % 5 <> 0),
u as (select event_id, value as x, q, len(list_filter(q, lambda v: v < value)) as b, len(list_filter(q, lambda v: v <= value)) as u from events, q),
p as (select event_id, least(greatest(case when b < u then (b + u - 1) / 2.0 when u = 0 then 0 when u = 1001 then 1000 else u - 1 + (x - q[u]) / (q[u + 1] - q[u]) end / 1000, 1e-7), 1 - 1e-7) as p from u),
r as (select event_id, p, p - 0.5 as q, (p - 0.5) * (p - 0.5) as r, sqrt(-2 * ln(least(p, 1 - p))) as s from p)
select event_id, round(case when abs(q) <= 0.5 - 0.02425 then {_horner(scalar._CENTRE, "r")} * q / {_horner(scalar._CENTRE_BELOW, "r")} else -sign(q) * {_horner(scalar._TAIL, "s")} / {_horner(scalar._TAIL_BELOW, "s")} end, 6) + 0.0 as value from r""")
def quantile_normal(spark, d):
    df = read(spark, d, "events").select("event_id", "value")
    out = scalar.quantile_normal(df, scalar.fit_quantiles(df.where("event_id % 5 <> 0"), ["value"]))
    return out.select("event_id", (F.round("value", 6) + 0.0).alias("value"))


@query("target_scale", "with m as (select avg(o_totalprice) as a, stddev_pop(o_totalprice) as s from orders where o_orderkey % 5 <> 0) select o_orderkey, round(case when o_orderkey % 5 <> 0 then (o_totalprice - a) / s else o_totalprice end, 6) as y, round(o_totalprice, 4) as back, round(ln(1 + o_totalprice), 6) as log_y from orders, m")
def target_scale(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("raw"))
    fitted = scalar.fit_standard(df.where("o_orderkey % 5 <> 0").select("raw"), ["raw"])
    out = scalar.unscale_target(scalar.scale_target(df, fitted, "raw", "scaled"), fitted, "raw", "scaled", "back")
    y = F.when(F.col("o_orderkey") % 5 != 0, F.col("scaled")).otherwise(F.col("raw"))
    return out.select("o_orderkey", F.round(y, 6).alias("y"), F.round("back", 4).alias("back"), F.round(F.log1p("raw"), 6).alias("log_y"))
