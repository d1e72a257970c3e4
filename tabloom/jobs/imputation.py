"""Queries of imputation and of rolling statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.jobs.registry import query, read
from tabloom.operators import impute, windows

SQL = "with c as (select c_custkey, c_nationkey, case when c_custkey % 7 <> 0 then c_mktsegment end as s, case when c_custkey % 4 <> 0 then c_acctbal end as v from customer)"


def customers(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(k % 7 != 0, F.col("c_mktsegment")).alias("s"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("v"))


@query("fill_constant", SQL + " select c_custkey, c_nationkey, coalesce(s, 'None') as s, coalesce(v, 0) as v from c")
def fill_constant(spark, d):
    return impute.fill_by_kind(customers(spark, d))


@query("fill_mode", SQL + " select c_custkey, coalesce(s, (select s from c where s is not null group by s order by count(*) desc, s limit 1)) as s from c")
def fill_mode(spark, d):
    df = customers(spark, d).select("c_custkey", "s")
    return impute.fill_from(df, impute.fit_mode(df, "s"), "s", "mode")


@query("fill_group_mode", SQL + ", m as (select c_nationkey, s as mode from (select c_nationkey, s, row_number() over (partition by c_nationkey order by count(*) desc, s) as r from c where s is not null group by 1, 2) where r = 1) select c_custkey, coalesce(s, mode) as s from c left join m using (c_nationkey)")
def fill_group_mode(spark, d):
    df = customers(spark, d)
    return impute.fill_from(df, impute.fit_mode(df, "s", ["c_nationkey"]), "s", "mode", ["c_nationkey"]).select("c_custkey", "s")


@query("fill_group_median", SQL + ", m as (select c_nationkey, median(v) as md from c group by 1) select c_custkey, round(coalesce(v, md), 4) as v from c left join m using (c_nationkey)")
def fill_group_median(spark, d):
    df = customers(spark, d)
    return impute.fill_from(df, impute.fit_median(df, "v", ["c_nationkey"]), "v", "median", ["c_nationkey"]).select("c_custkey", F.round("v", 4).alias("v"))


@query("interpolate_group", """
with e as (select user_id, event_id, case when event_id % 3 <> 0 and user_id % 11 <> 0 then value end as v, row_number() over (partition by user_id order by ts, event_id) as p from events),
f as (select *, last_value(case when v is not null then p end ignore nulls) over b as p0, first_value(case when v is not null then p end ignore nulls) over a as p1,
    last_value(v ignore nulls) over b as v0, first_value(v ignore nulls) over a as v1 from e
  window b as (partition by user_id order by p rows between unbounded preceding and current row), a as (partition by user_id order by p rows between current row and unbounded following))
select user_id, event_id, round(coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1), 6) as v from f""")
def interpolate_group(spark, d):
    v = F.when((F.col("event_id") % 3 != 0) & (F.col("user_id") % 11 != 0), F.col("value"))
    df = read(spark, d, "events").select("user_id", "event_id", "ts", v.alias("v"))
    return impute.add_interpolated(df, "v", ["user_id"], ["ts", "event_id"], "w").select("user_id", "event_id", F.round("w", 6).alias("v"))


#: Rows in a chunk of the queries on a hot entity, so that it is cut at every size.
HOT_ROWS = 1000
#: Events of which one user has a third, with gaps; long ones at the hot user.
HOT = "select case when event_id % 3 = 0 then 0 else user_id end as user_id, event_id, ts, case when event_id % 5 <> 0 and not (event_id % 3 = 0 and event_id % 1000 < 600) then value end as v from events"


def hot_events(spark, d):
    k = F.col("event_id")
    v = F.when((k % 5 != 0) & ~((k % 3 == 0) & (k % 1000 < 600)), F.col("value"))
    return read(spark, d, "events").select(F.when(k % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), "event_id", "ts", v.alias("v"))


@query("interpolate_hot", f"""
with e as (select *, row_number() over (partition by user_id order by ts, event_id) as p from ({HOT})),
f as (select *, last_value(case when v is not null then p end ignore nulls) over b as p0, first_value(case when v is not null then p end ignore nulls) over a as p1,
    last_value(v ignore nulls) over b as v0, first_value(v ignore nulls) over a as v1 from e
  window b as (partition by user_id order by p rows between unbounded preceding and current row), a as (partition by user_id order by p rows between current row and unbounded following))
select user_id, event_id, round(coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0, v1), 6) as v from f""")
def interpolate_hot(spark, d):
    """Gaps of an entity that holds a third of all rows, filled over chunk borders."""
    out = impute.add_interpolated(hot_events(spark, d), "v", ["user_id"], ["ts", "event_id"], "w", HOT_ROWS)
    return out.select("user_id", "event_id", F.round("w", 6).alias("v"))


@query("rolling_stats", """
with e as (select user_id, event_id, ts, case when event_id % 5 <> 0 then value end as v from events),
w as (select user_id, event_id, count(v) over k as n, avg(v) over k as mean, quantile_cont(v, 0.5) over k as median, min(v) over k as min, max(v) over k as max, stddev_samp(v) over k as std, skewness(v) over k as skew from e
  window k as (partition by user_id order by ts, event_id rows between 17 preceding and current row))
select user_id, event_id, round(mean, 7) as v_mean, round(median, 7) as v_median, min as v_min, max as v_max, round(coalesce(std, 0), 5) as v_std,
  round(case when n < 3 or coalesce(std, 0) = 0 or skew is null or isnan(skew) then 0 else skew end, 3) + 0.0 as v_skew from w""")
def rolling_stats(spark, d):
    df = read(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    out = windows.add_rolling(df, "v", ["user_id"], ["ts", "event_id"], [18])
    return out.select("user_id", "event_id", *(F.round(f"v_{k}_18", 7).alias(f"v_{k}") for k in ("mean", "median")), F.col("v_min_18").alias("v_min"), F.col("v_max_18").alias("v_max"), F.round("v_std_18", 5).alias("v_std"), (F.round("v_skew_18", 3) + 0.0).alias("v_skew"))


#: Window lengths of the weather lags.
LAGS = (3, 18, 72)


@query("rolling_hot", f"with e as ({HOT}) select user_id, event_id, " + ", ".join(f"round(avg(v) over w{k}, 9) as mean_{k}, round(quantile_cont(v, 0.5) over w{k}, 9) as median_{k}, min(v) over w{k} as min_{k}, max(v) over w{k} as max_{k}, round(coalesce(stddev_samp(v) over w{k}, 0), 5) as std_{k}" for k in LAGS) + " from e window " + ", ".join(f"w{k} as (partition by user_id order by ts, event_id rows between {k - 1} preceding and current row)" for k in LAGS))
def rolling_hot(spark, d):
    """Lags of several lengths where one entity holds a third of all rows, in chunks with halos."""
    out = windows.add_rolling(hot_events(spark, d), "v", ["user_id"], ["ts", "event_id"], LAGS, HOT_ROWS)
    rounded = {"mean": 9, "median": 9, "std": 5}
    return out.select("user_id", "event_id", *((F.round(f"v_{k}_{n}", rounded[k]) if k in rounded else F.col(f"v_{k}_{n}")).alias(f"{k}_{n}") for n in LAGS for k in ("mean", "median", "min", "max", "std")))
