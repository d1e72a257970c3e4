"""Queries of the category encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.jobs.registry import query, read
from tabloom.operators import encode

#: Orders with derived nulls, train where the key is not a multiple of 5.
ORDERS = "with o as (select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderpriority end as p, o_orderkey % 5 <> 0 as train, o_totalprice as y, o_custkey from orders)"


def orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("p"), (F.col("o_orderkey") % 5 != 0).alias("train"), F.col("o_totalprice").alias("y"), "o_custkey")


def halves(df):
    return df.where("train"), df.where("not train")


@query("ordinal_encode", ORDERS + ", c as (select p, row_number() over (order by count(*) desc, p)::int as code from o where train and p is not null and p <> '5-LOW' group by p) select o_orderkey, code from o left join c using (p)")
def ordinal_encode(spark, d):
    df = orders(spark, d)
    return encode.apply_codes(df, encode.fit_ordinal(df.where("train and p <> '5-LOW'"), "p"), "p", "code").select("o_orderkey", "code")


@query("label_encode", ORDERS + ", c as (select p, (row_number() over (order by p) - 1)::int as code from (select distinct p from o where p is not null)) select o_orderkey, code from o left join c using (p)")
def label_encode(spark, d):
    df = orders(spark, d)
    return encode.apply_codes(df, encode.fit_labels(df, "p", classes=5), "p", "code").select("o_orderkey", "code")


@query("factorize_union", ORDERS + ", c as (select p, (row_number() over (order by p) - 1)::int as code from (select distinct p from o where p is not null)) select o_orderkey, train, coalesce(code, -1) as code, coalesce(code, -1) + 1 as code_from_0 from o left join c using (p)")
def factorize_union(spark, d):
    train, test = halves(df := orders(spark, d))
    out = encode.apply_codes(df, encode.fit_factors(train, test, "p"), "p", "code", missing=-1)
    return out.select("o_orderkey", "train", "code", (F.col("code") + 1).alias("code_from_0"))


@query("freq_encode", ORDERS + ", c as (select p, count(*) / (select count(p) from o) as f from o where p is not null group by p), e as (select o_custkey, count(*) / (select count(*) from o) as g from o group by 1) select o_orderkey, round(f, 8) as p_freq, round(g, 8) as o_custkey_freq from o left join c using (p) left join e using (o_custkey)")
def freq_encode(spark, d):
    train, test = halves(df := orders(spark, d))
    out = encode.apply_frequency(df, encode.fit_frequency(train, test, ["p", "o_custkey"]), ["p", "o_custkey"])
    return out.select("o_orderkey", F.round("p_freq", 8).alias("p_freq"), F.round("o_custkey_freq", 8).alias("o_custkey_freq"))


@query("count_encode", ORDERS + " select o_orderkey, case when p is not null then count(*) over (partition by p) end as p_counts from o")
def count_encode(spark, d):
    return encode.count_encode(orders(spark, d), "p").select("o_orderkey", "p_counts")


@query("target_mean_encode", ORDERS + ", t as (select o_custkey, avg(y) as m from o where train group by 1 having count(*) > 1) select o_orderkey, train, round(coalesce(m, (select avg(y) from o where train)), 6) as encoded from o left join t using (o_custkey)")
def target_mean_encode(spark, d):
    df = orders(spark, d)
    out = encode.apply_target_mean(df, encode.fit_target_mean(df.where("train"), "o_custkey", "y"), "o_custkey", "encoded")
    return out.select("o_orderkey", "train", F.round("encoded", 6).alias("encoded"))


@query("rare_collapse", "with t as (select p_partkey, case when p_partkey % 7 <> 0 then p_type end as t from part), c as (select t from t group by t having count(*) > (select count(*) / 8 from part)) select p_partkey, case when t in (select t from c where t is not null) then t else 'Other' end as t from t")
def rare_collapse(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("t"))
    return encode.collapse_rare(part, "t", int(part.count() / 8))


@query("keyword_class", "select p_partkey, case when p_partkey % 7 = 0 then 'Street' when contains(p_name, 'e ') then 'A' when contains(p_name, 'ing') then 'B' when contains(p_name, 'o') then 'C' end as class from part")
def keyword_class(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("name"))
    return part.select("p_partkey", encode.keyword_class("name", [("e ", "A"), ("ing", "B"), ("o", "C")], "Street").alias("class"))


@query("token_k", "with t as (select p_partkey, string_split_regex(trim(p_name), '\\s+') as w from part) select p_partkey, w[1] as first, w[2] as second, w[3] as third from t")
def token_k(spark, d):
    return read(spark, d, "part").select("p_partkey", *(encode.token("p_name", k).alias(n) for k, n in enumerate(("first", "second", "third"))))


@query("map_lookup", "select o_orderkey, case o_orderpriority when '1-URGENT' then 0.0 when '2-HIGH' then 0.25 when '3-MEDIUM' then 0.5 end::double as heading from orders")
def map_lookup(spark, d):
    known = {"1-URGENT": 0.0, "2-HIGH": 0.25, "3-MEDIUM": 0.5}
    return read(spark, d, "orders").select("o_orderkey", encode.lookup("o_orderpriority", known).alias("heading"))


@query("feature_cross", ORDERS + " select o_orderkey, coalesce(p, 'nan') || '_' || o_custkey as crossed from o")
def feature_cross(spark, d):
    return orders(spark, d).select("o_orderkey", encode.cross("p", "o_custkey").alias("crossed"))


@query("equality_flag", "select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_partkey % 7 <> 0 then l_returnflag end = case when l_suppkey % 7 <> 0 then l_linestatus end or l_returnflag = 'A' and l_linestatus = 'F' and l_partkey % 7 <> 0 and l_suppkey % 7 <> 0, false)::int as same from lineitem")
def equality_flag(spark, d):
    a = F.when(F.col("l_partkey") % 7 != 0, F.when(F.col("l_returnflag") == "A", "F").otherwise(F.col("l_returnflag")))
    df = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_linestatus")).alias("b"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", encode.equal_flag("a", "b").alias("same"))


@query("threshold_flags", "select event_id, (value > 50)::int as large, (hour(ts) > 5 and hour(ts) < 20)::int as day from events")
def threshold_flags(spark, d):
    return read(spark, d, "events").select("event_id", encode.between_flag(F.col("value"), 50).alias("large"), encode.between_flag(F.hour("ts"), 5, 20).alias("day"))


@query("one_hot", "select c_custkey, c_acctbal, " + ", ".join(f"(s is not distinct from '{v}')::int as \"seg_{v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + ", " + ", ".join(f"(c_nationkey % 3 = {k})::int as \"zone_{k}\"" for k in range(3)) + " from (select *, case when c_custkey % 7 <> 0 then c_mktsegment end as s from customer)")
def one_hot(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("seg"), (F.col("c_nationkey") % 3).cast("string").alias("zone"))
    return encode.one_hot(df, ["seg", "zone"])


@query("distinct_elements", "select distinct unnest(string_split(trim(replace(p_type || ',' || p_brand, ' ', ',')), ',')) as element from part")
def distinct_elements(spark, d):
    return encode.distinct_elements(read(spark, d, "part").select(F.replace(F.concat_ws(",", "p_type", "p_brand"), F.lit(" "), F.lit(",")).alias("x")), "x")
