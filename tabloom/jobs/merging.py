"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.jobs.registry import query, read
from tabloom.operators import merge

PART = "with p as (select p_partkey as l_partkey, p_size, p_retailprice from part where p_partkey % 10 <> 3)"


def part(spark, d):
    return read(spark, d, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")


@query("left_join_dim", PART + " select l_orderkey, l_linenumber, l_partkey, p_size from lineitem left join p using (l_partkey)")
def left_join_dim(spark, d):
    return merge.left_join(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), part(spark, d).select("l_partkey", "p_size"), ["l_partkey"])


@query("left_join_hot", PART + ", l as (select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then 1 when l_orderkey % 4 = 1 then null else l_partkey end as l_partkey from lineitem) select l_orderkey, l_linenumber, l_partkey, p_size from l left join p using (l_partkey)")
def left_join_hot(spark, d):
    """One part holds half of all facts, and a quarter of them have none."""
    k = F.col("l_orderkey")
    fact = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(k % 2 == 0, 1).when(k % 4 != 1, F.col("l_partkey")).alias("l_partkey"))
    return merge.left_join(fact, part(spark, d).select("l_partkey", "p_size"), ["l_partkey"])


COMPOSITE = "with s as (select l_suppkey, l_returnflag, avg(l_quantity) as q_mean from lineitem where l_linenumber > 1 group by 1, 2), t as (select l_suppkey, l_returnflag, l_linenumber, max(l_quantity) as q_max from lineitem where l_linenumber > 1 group by 1, 2, 3)"


@query("left_join_composite", COMPOSITE + " select l_orderkey, l_linenumber, l_suppkey, l_returnflag, round(q_mean, 6) as q_mean, q_max from lineitem left join s using (l_suppkey, l_returnflag) left join t using (l_suppkey, l_returnflag, l_linenumber)")
def left_join_composite(spark, d):
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    rest = df.where("l_linenumber > 1")
    s = rest.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("q_mean"))
    t = rest.groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(F.max("l_quantity").alias("q_max"))
    return merge.left_join(merge.left_join(df, s, ["l_suppkey", "l_returnflag"]), t, ["l_suppkey", "l_returnflag", "l_linenumber"]).drop("l_quantity")


@query("semi_join", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)")
def semi_join(spark, d):
    ids = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left_semi")


@query("fit_apply_stats", "with e as (select *, event_id % 5 <> 0 as train from events), s as (select user_id, event_type, avg(value) as m, median(value) as md from e where train group by 1, 2) select event_id, train, round(m, 6) as v_mean, round(md, 6) as v_median from e left join s using (user_id, event_type)")
def fit_apply_stats(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.col("event_id") % 5 != 0).alias("train"))
    keys = ["user_id", "event_type"]
    out = merge.apply_group_stats(e, merge.fit_group_stats(e.where("train"), keys, "value", "v"), keys)
    return out.select("event_id", "train", F.round("v_mean", 6).alias("v_mean"), F.round("v_median", 6).alias("v_median"))


@query("merge_pivot", PART + ", n as (select l_partkey, row_number() over (order by l_partkey) - 1 as r from p) select l_orderkey, l_linenumber, l_partkey, coalesce(r, (select count(*) from p))::int as \"@M_part\" from lineitem left join n using (l_partkey)")
def merge_pivot(spark, d):
    return merge.merge_pivot(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), part(spark, d), ["l_partkey"], "part")


@query("merged_histogram", PART + ", j as (select l_quantity as y, p_size, p_retailprice from lineitem left join p using (l_partkey)), b as (select 'p_size' as feature, case when p_size is null then -1 else (p_size >= 10)::int + (p_size >= 20)::int + (p_size >= 30)::int + (p_size >= 40)::int end as bin, y from j union all select 'p_retailprice', case when p_retailprice is null then -1 else (p_retailprice >= 1000)::int + (p_retailprice >= 1500)::int end, y from j) select 'part' as \"desc\", feature, bin, count(*) as n, round(sum(y), 4) as sum_y, round(sum(y * y), 4) as sum_y2 from b group by 2, 3")
def merged_histogram(spark, d):
    edges = {"p_size": [10, 20, 30, 40], "p_retailprice": [1000, 1500]}
    out = merge.merged_histogram(read(spark, d, "lineitem").select("l_partkey", "l_quantity"), part(spark, d), ["l_partkey"], "l_quantity", edges, "part")
    return out.select("desc", "feature", "bin", "n", F.round("sum_y", 4).alias("sum_y"), F.round("sum_y2", 4).alias("sum_y2"))


@query("override_known", "select o_orderkey, coalesce(k, o_totalprice) as value from orders left join (select o_orderkey, o_totalprice * 2 as k from orders where o_orderkey % 4 = 0) using (o_orderkey)")
def override_known(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    known = orders.where("o_orderkey % 4 = 0").select("o_orderkey", (F.col("value") * 2).alias("known"))
    return merge.override_known(orders, known, ["o_orderkey"], "value", "known")
