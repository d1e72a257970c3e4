"""Queries of aggregates, profiles, bins and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.jobs.registry import query, read
from tabloom.operators import stats


def events(spark, d):
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("group_mean_median", "select user_id, event_type, round(avg(v), 6) as mean, round(median(v), 6) as median from (select *, case when event_id % 7 <> 0 then value end as v from events) group by 1, 2")
def group_mean_median(spark, d):
    df = events(spark, d).withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return df.groupBy("user_id", "event_type").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"))


@query("group_agg_encode", "with e as (select event_id, user_id, case when event_id % 3 = 0 then null else value end as v from events), g as (select user_id, avg(v) as m, stddev_samp(v) as s from e where v is not null group by 1) select event_id, round(coalesce(m, -1), 5) as v_mean, round(coalesce(s, -1), 5) as v_std from e left join g using (user_id)")
def group_agg_encode(spark, d):
    df = events(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(F.col("value")).alias("v"))
    return stats.group_encode(df, "user_id", ["v"]).select("event_id", F.round("v_user_id_mean", 5).alias("v_mean"), F.round("v_user_id_std", 5).alias("v_std"))


_KEYS = ("user_id", "event_type", "day", "tenth")


@query("group_encode_all", "with e as (select event_id, user_id, event_type, (day(ts))::varchar as day, floor(value / 10) as tenth, case when event_id % 3 = 0 then null else value end as v, event_id % 100 as w from events) select event_id, " + ", ".join(f"round(coalesce(avg({v}) over (partition by {k}), -1), 7) as {v}_{k}_mean, round(coalesce(stddev_samp({v}) over (partition by {k}), -1), 5) as {v}_{k}_std" for k in _KEYS for v in ("v", "w")) + " from e")
def group_encode_all(spark, d):
    """Four keys and two values in one pass; key columns of few levels do not move the facts."""
    k = F.col("event_id")
    df = read(spark, d, "events").select("event_id", "user_id", "event_type", F.dayofmonth("ts").cast("string").alias("day"), F.floor(F.col("value") / 10).alias("tenth"), F.when(k % 3 == 0, -1.0).otherwise(F.col("value")).alias("v"), (k % 100).cast("double").alias("w"))
    out = stats.group_encode_all(df, _KEYS, ["v", "w"], row_key="event_id")
    return out.select("event_id", *(F.round(f"{v}_{k}_{n}", 7 if n == "mean" else 5).alias(f"{v}_{k}_{n}") for k in _KEYS for v in ("v", "w") for n in ("mean", "std")))


@query("nunique_encode", "select event_id, count(distinct event_type) over (partition by user_id) as ct from events")
def nunique_encode(spark, d):
    return stats.nunique_encode(events(spark, d), "user_id", "event_type").select("event_id", F.col("user_id_event_type_ct").alias("ct"))


@query("value_counts", "select event_type as value, count(*) as n, round(count(*) / (select count(*) from events), 8) as share from events group by 1")
def value_counts(spark, d):
    return stats.value_counts(events(spark, d), "event_type").select("value", "n", F.round("share", 8).alias("share"))


@query("null_counts", "select 'a' as \"column\", sum((event_id % 7 = 0)::int)::bigint as nulls from events union all select 'b', sum((event_type = 'click')::int)::bigint from events union all select 'value', 0 from events where event_id = (select min(event_id) from events)")
def null_counts(spark, d):
    return stats.null_counts(events(spark, d).select(F.when(F.col("event_id") % 7 != 0, 1).alias("a"), F.nullif("event_type", F.lit("click")).alias("b"), "value"))


@query("column_skew", "with m as (select avg(value) as a, avg(event_id::double) as b from events) select 'value' as \"column\", round(avg(pow(value - a, 3)) / pow(avg(pow(value - a, 2)), 1.5), 5) as skew from events, m union all select 'event_id', round(avg(pow(event_id - b, 3)) / pow(avg(pow(event_id - b, 2)), 1.5), 5) + 0.0 from events, m")
def column_skew(spark, d):
    return stats.column_skew(events(spark, d), ["value", "event_id"]).select("column", (F.round("skew", 5) + 0.0).alias("skew"))


@query("column_profile", "select 'o_orderkey' as \"column\", 'bigint' as type, 'number' as kind, min(o_orderkey)::double as lo, max(o_orderkey)::double as hi from orders union all select 'o_totalprice', 'double', 'number', min(o_totalprice), max(o_totalprice) from orders union all select 'o_orderstatus', 'string', 'category', null, null union all select 'o_orderdate', 'timestamp_ntz', 'other', null, null")
def column_profile(spark, d):
    return stats.column_profile(read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"))


@query("unique_flag", "with c as (select event_id, count(*) over (partition by value) = 1 as u, count(*) over (partition by user_id, event_type) = 1 as w, count(*) over (partition by floor(value * 10)) = 1 as x from events) select event_id, (u::int + w::int + x::int = 2)::int as flag from c")
def unique_flag(spark, d):
    df = events(spark, d).select("event_id", "value", F.concat_ws("-", "user_id", "event_type").alias("pair"), F.floor(F.col("value") * 10).alias("tenth"))
    return stats.unique_flag(df, "event_id", ["value", "pair", "tenth"])


@query("class_histogram", "with e as (select case when event_id % 5 = 0 then 'test' when event_type = 'purchase' then '1' else '0' end as class, value as x from events), m as (select min(x) as lo, max(x) as hi from e), s as (select bins::int as bins, class, least(floor((x - lo) / ((hi - lo) / bins)), bins - 1)::int as bin, (hi - lo) / bins as w from e, m, (values (10), (50)) t(bins)), n as (select bins, class, bin, w, count(*) as n from s group by all) select bins, class, bin, n, round(n / (sum(n) over (partition by bins, class) * w), 8) as density from n")
def class_histogram(spark, d):
    label = F.when(F.col("event_id") % 5 == 0, "test").when(F.col("event_type") == "purchase", "1").otherwise("0")
    out = stats.class_histogram(events(spark, d).select(label.alias("label"), "value"), "value", "label", [10, 50])
    return out.select("bins", "class", "bin", "n", F.round("density", 8).alias("density"))


@query("joint_summary", "(select 'line' as part, 0::bigint as id, round(regr_slope(l_extendedprice, l_quantity), 5) as a, round(regr_intercept(l_extendedprice, l_quantity), 4) as b from lineitem) union all (select 'top', p_partkey, p_retailprice, p_size::double from part order by p_retailprice desc, p_partkey limit 5) union all (select 'bin', least(floor((l_quantity - 1) / (49 / 150.0)), 149)::bigint, count(*)::double, null from lineitem group by 2)")
def joint_summary(spark, d):
    items = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    line = stats.fit_line(items, "l_quantity", "l_extendedprice").select(F.lit("line").alias("part"), F.lit(0).cast("bigint").alias("id"), F.round("slope", 5).alias("a"), F.round("intercept", 4).alias("b"))
    top = read(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select(F.lit("top"), "p_partkey", "p_retailprice", F.col("p_size").cast("double"))
    bins = stats.class_histogram(items.withColumn("label", F.lit(0)), "l_quantity", "label", [150]).select(F.lit("bin"), F.col("bin").cast("bigint"), F.col("n").cast("double"), F.lit(None).cast("double"))
    return line.union(top).union(bins)


@query("fit_line", "select l_returnflag, l_linenumber, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by 1, 2 union all select 'one', 0, count(*), null, null from lineitem")
def fit_line(spark, d):
    df = read(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice")
    flat = df.select(F.lit("one").alias("l_returnflag"), F.lit(0).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), "l_extendedprice")
    out = stats.fit_line(df.union(flat), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linenumber"])
    return out.select("l_returnflag", "l_linenumber", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


def _bin(x, lo, hi):
    return f"greatest(1, least(30, ceil(({x} - {lo}) * 30 / ({hi} - {lo}))))::int"


@query("equal_width_bins", f"with s as (select c_custkey as id, c_acctbal as x from customer union all select -s_suppkey - 1, s_acctbal from supplier), m as (select min(x) as lo, max(x) as hi from s) select id, {_bin('x', 'lo', 'hi')} as bin from s, m")
def equal_width_bins(spark, d):
    both = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")).union(read(spark, d, "supplier").select(-F.col("s_suppkey") - 1, "s_acctbal"))
    ends = both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return both.crossJoin(F.broadcast(ends)).select("id", stats.equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), 30).alias("bin"))


@query("grid_2d", f"with m as (select min(l_quantity) as a, max(l_quantity) as b, min(l_extendedprice) as c, max(l_extendedprice) as e from lineitem), s as (select {_bin('l_quantity', 'a', 'b')} as i, {_bin('l_extendedprice', 'c', 'e')} as j from lineitem, m) select i || '_' || j as cell, count(*) as n from s group by 1")
def grid_2d(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    ends = df.agg(*(f(c).alias(n) for c, lo, hi in (("l_quantity", "a", "b"), ("l_extendedprice", "c", "e")) for f, n in ((F.min, lo), (F.max, hi))))
    i = stats.equal_width_bin(F.col("l_quantity"), F.col("a"), F.col("b"), 30)
    j = stats.equal_width_bin(F.col("l_extendedprice"), F.col("c"), F.col("e"), 30)
    return df.crossJoin(F.broadcast(ends)).groupBy(F.concat_ws("_", i, j).alias("cell")).agg(F.count("*").alias("n"))


_EDGES = "with q as (select list_sort(list_distinct(quantile_cont(value, [" + ", ".join(f"{k / 16}" for k in range(1, 16)) + "]))) as e from events)"


@query("quantile_bins", _EDGES + " select event_id, len(list_filter(e, lambda x: x <= value))::int as bin from events, q")
def quantile_bins(spark, d):
    df = events(spark, d)
    edges = stats.fit_bins(df, ["value"], 16)["value"]
    return df.select("event_id", stats.bin_of(F.col("value"), edges).alias("bin"))


_OFTEN = "with e as (select event_id, case when event_id % 5 < 2 then 7.5 when event_id % 11 <> 0 then value end as x from events), h as (select x from e where x is not null group by x having count(*) * 16 > (select count(x) from e)), k as (select 16 - count(*) as k from h), r as (select x, row_number() over (order by x) - 1 as p, count(*) over () as n from e where x is not null and x not in (select x from h)), w as (select i / k::double * (n - 1) as w from k, range(1, 16) t(i), (select max(n) as n from r) where i < k), q as (select a.x + (b.x - a.x) * (w - floor(w)) as b from w join r a on a.p = floor(w) join r b on b.p = ceil(w)), b as (select distinct b from (select b from q union all select x from h union all select nextafter(x, 'inf'::double) from h))"


@query("frequency_bins", _OFTEN + " select event_id, case when x is null then -1 else len(list_filter(l, lambda b: b <= x)) end::int as bin from e, (select list(b) as l from b)")
def frequency_bins(spark, d):
    """Values that are frequent have bins of their own: one holds 40 % of the rows."""
    k = F.col("event_id")
    df = events(spark, d).select("event_id", F.when(k % 5 < 2, 7.5).when(k % 11 != 0, F.col("value")).alias("x"))
    return df.select("event_id", stats.bin_of(F.col("x"), stats.fit_bins(df, ["x"], 16, mode="frequency")["x"]).alias("bin"))


_TARGETS = _EDGES + ", b as (select 'value' as feature, len(list_filter(e, lambda x: x <= value))::int as bin, hour(ts)::double as y from events, q union all select 'code', (user_id % 4)::int, hour(ts)::double from events), s as (select feature, bin, count(*) as n, sum(y) as sum_y, sum(y * y) as sum_y2 from b group by 1, 2)"


def _binned(spark, d):
    df = read(spark, d, "events").select("value", (F.col("user_id") % 4).cast("double").alias("code"), F.hour("ts").cast("double").alias("y"))
    return stats.bin_target_stats(df, stats.fit_bins(df, ["value", "code"], 16), "y")


@query("bin_target_stats", _TARGETS + " select * from s")
def bin_target_stats(spark, d):
    return _binned(spark, d)


@query("best_split", _TARGETS + ", r as (select feature, bin, sum(n) over u as ln, sum(sum_y) over u as ls, sum(n) over t as tn, sum(sum_y) over t as ts from s window u as (partition by feature order by bin), t as (partition by feature)), g as (select feature, bin, ls * ls / ln + (ts - ls) * (ts - ls) / nullif(tn - ln, 0) - ts * ts / tn as gain from r where ln >= 20 and tn - ln >= 20) select feature, bin, round(gain, 4) as gain from (select *, row_number() over (partition by feature order by gain desc, bin) as k from g) where k = 1")
def best_split(spark, d):
    return stats.best_split(_binned(spark, d)).select("feature", "bin", F.round("gain", 4).alias("gain"))


_IMPORTANCE = "with f as (select p_brand as feature, p_size % 5 as fold, case when p_brand like '%1' then 0 else avg(p_retailprice) end as importance from part group by 1, 2)"


@query("top_importance", _IMPORTANCE + ", m as (select feature, avg(importance) as i from f group by 1 having avg(importance) > 0 order by 2 desc, 1 limit 10) select feature, round(i, 5) as importance, round(i / max(i) over (), 6) as weight from m")
def top_importance(spark, d):
    folds = read(spark, d, "part").groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") % 5).alias("fold")).agg(F.avg("p_retailprice").alias("importance"))
    folds = folds.withColumn("importance", F.when(F.col("feature").like("%1"), 0.0).otherwise(F.col("importance")))
    return stats.top_importance(folds, 10).select("feature", F.round("importance", 5).alias("importance"), F.round("weight", 6).alias("weight"))
