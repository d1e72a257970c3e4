"""Queries of projections, filters, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.keys import bucket
from tabloom.jobs.registry import query, read
from tabloom.operators import folds, select

B = "('0x'||substr(md5('{seed}:'||{key}::varchar),1,8))::bigint"


def sql_bucket(key: str, seed: int = 0) -> str:
    return B.format(seed=seed, key=key)


@query("feature_projection", "select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate from lineitem")
def feature_projection(spark, d):
    return select.features(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("filter_negated", "select * from orders where not coalesce(o_orderstatus = 'F' and nullif(o_custkey % 7, 0) <= 3 and o_orderdate < timestamp '1996-05-21', false)")
def filter_negated(spark, d):
    late = F.col("o_orderdate") < F.lit("1996-05-21").cast("timestamp_ntz")
    return select.drop_where(read(spark, d, "orders"), (F.col("o_orderstatus") == "F") & (F.nullif(F.col("o_custkey") % 7, F.lit(0)) <= 3) & late)


@query("filter_outlier_target", "select l_orderkey, l_linenumber, l_quantity, l_extendedprice, (l_quantity > 10)::int as target from (select *, case when l_partkey % 7 <> 0 then l_quantity end q from lineitem) where q is not null and not (l_extendedprice > 90000 and q < 48)")
def filter_outlier_target(spark, d):
    df = read(spark, d, "lineitem").withColumn("q", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity"))).dropna(subset=["q"])
    df = select.drop_where(df, (F.col("l_extendedprice") > 90000) & (F.col("q") < 48))
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_quantity") > 10).cast("int").alias("target"))


@query("time_block_split", "select o_orderkey, block, case when block < 33 then 'train' when block = 33 then 'valid' when block = 34 then 'test' end as split from (select o_orderkey, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::int as block from orders)")
def time_block_split(spark, d):
    block = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int")
    return read(spark, d, "orders").select("o_orderkey", block.alias("block")).withColumn("split", select.split_by_value("block", 33, 33, 34))


@query("holdout_with_gap", "with b as (select o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate))::int as block from orders) select *, case when block = (select max(block) from b) then 'test' when block < (select max(block) from b) - 1 then 'train' end as split from b")
def holdout_with_gap(spark, d):
    return select.holdout_with_gap(read(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("block")), "block")


@query("pick_samples", f"(select 'train' as split, o_orderkey from orders where o_orderkey % 5 <> 0 order by {sql_bucket('o_orderkey', 42)}, o_orderkey limit 100) union all (select 'test', o_orderkey from orders where o_orderkey % 5 = 0 order by {sql_bucket('o_orderkey', 42)}, o_orderkey limit 100)")
def pick_samples(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey")
    part = lambda name, where: select.pick_samples(orders.where(where), "o_orderkey", 100).select(F.lit(name).alias("split"), "o_orderkey")
    return part("train", "o_orderkey % 5 <> 0").union(part("test", "o_orderkey % 5 = 0"))


@query("pick_samples_aligned", f"with n as (select c_custkey as row_no from customer order by {sql_bucket('c_custkey', 42)}, c_custkey limit 50) select 'train' as split, c_custkey as row_no, c_acctbal as value from customer where c_custkey in (select row_no from n) union all select 'test', s_suppkey, s_acctbal from supplier where s_suppkey in (select row_no from n)")
def pick_samples_aligned(spark, d):
    one = read(spark, d, "customer").select(F.lit("train").alias("split"), F.col("c_custkey").alias("row_no"), F.col("c_acctbal").alias("value"))
    two = read(spark, d, "supplier").select(F.lit("test").alias("split"), F.col("s_suppkey").alias("row_no"), F.col("s_acctbal").alias("value"))
    chosen = F.broadcast(select.pick_samples(one.select("row_no"), "row_no", 50))
    return one.join(chosen, "row_no", "left_semi").unionByName(two.join(chosen, "row_no", "left_semi"))


@query("sample_fraction", f"select event_id, value from events where {sql_bucket('event_id', 42)} < 1073741824")
def sample_fraction(spark, d):
    return select.sample_fraction(read(spark, d, "events").select("event_id", "value"), "event_id", 0.25)


@query("constant_columns", "select 'l_quantity' as \"column\", min(l_quantity) = max(l_quantity) as is_constant from lineitem union all select 'l_tax', min(l_tax) = max(l_tax) from lineitem union all select 'one', true union all select 'none', true")
def constant_columns(spark, d):
    df = read(spark, d, "lineitem").select("l_quantity", "l_tax", F.lit(1).alias("one"), F.lit(None).cast("double").alias("none"))
    return select.constant_columns(df, df.columns)


@query("near_constant_columns", "with c as (select 'l_returnflag' as \"column\", l_returnflag as v from lineitem union all select 'l_discount', l_discount::varchar from lineitem union all select 'rare', (l_orderkey % 5000 = 1)::varchar from lineitem), n as (select \"column\", v, count(*) as n from c group by all) select \"column\", round(max(n) / sum(n), 6) as share, max(n) / sum(n) > 0.9994 as dropped from n group by 1")
def near_constant_columns(spark, d):
    df = read(spark, d, "lineitem").select("l_returnflag", "l_discount", (F.col("l_orderkey") % 5000 == 1).alias("rare"))
    return select.dominant_share(df, df.columns).select("column", F.round("share", 6).alias("share"), (F.col("share") > 0.9994).alias("dropped"))


@query("drop_positions", "select c_custkey, c_acctbal from (select *, row_number() over (order by c_custkey) - 1 as p from customer) where p not in (3, 5, 8, 13, 21)")
def drop_positions(spark, d):
    numbered = folds.global_row_number(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    gone = spark.createDataFrame([(x,) for x in (3, 5, 8, 13, 21)], "row_no long")
    return numbered.join(F.broadcast(gone), "row_no", "left_anti").select("c_custkey", "c_acctbal")


@query("narrow_types", "with m as (select 'l_linenumber' as \"column\", min(l_linenumber)::double as lo, max(l_linenumber)::double as hi, true as i from lineitem union all select 'l_orderkey', min(l_orderkey), max(l_orderkey), true from lineitem union all select 'l_partkey', min(l_partkey), max(l_partkey), true from lineitem union all select 'edge', 0, 127, true union all select 'l_tax', min(l_tax), max(l_tax), false from lineitem) select \"column\", lo, hi, case when not i then 'float' when lo > -128 and hi < 127 then 'tinyint' when lo > -32768 and hi < 32767 then 'smallint' when lo > -2147483648 and hi < 2147483647 then 'int' else 'bigint' end as type from m")
def narrow_types(spark, d):
    df = read(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") == 1, 127).otherwise(0).alias("edge"), "l_tax")
    return select.narrow_types(df, df.columns)


@query("head_tail_split", "with r as (select event_id, row_number() over (order by event_id) as p, count(*) over () as n from events) select event_id, case when p <= n - 1000 then 'train' else 'test' end as split from r")
def head_tail_split(spark, d):
    return select.head_tail(read(spark, d, "events").select("event_id"), "event_id", 1000)


@query("union_split", "select 'train' as split, c_custkey as id, log(1 + abs(c_acctbal)) > 3 as large from customer union all select 'test', s_suppkey, log(1 + abs(s_acctbal)) > 3 from supplier")
def union_split(spark, d):
    one = read(spark, d, "customer").select(F.lit("train").alias("split"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    two = read(spark, d, "supplier").select(F.lit("test").alias("split"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))
    return one.unionByName(two).select("split", "id", (F.log10(1 + F.abs("x")) > 3).alias("large"))


@query("distinct_ids", "select distinct user_id from events")
def distinct_ids(spark, d):
    return read(spark, d, "events").select("user_id").distinct()


@query("top_n", "select event_id, value from events order by value desc, event_id limit 25")
def top_n(spark, d):
    return read(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("kfold_ids", f"select o_orderkey, ((row_number() over (order by {sql_bucket('o_orderkey', 7)}, o_orderkey) - 1) % 5)::int as fold from orders")
def kfold_ids(spark, d):
    return folds.kfold_shuffled(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, seed=7)


@query("kfold_contiguous", "select o_orderkey, ((row_number() over (order by o_orderkey) - 1) * 5 // count(*) over ())::int as fold from orders")
def kfold_contiguous(spark, d):
    return folds.kfold_contiguous(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("kfold_stratified", f"select o_orderkey, o_orderstatus, ((row_number() over (partition by o_orderstatus order by {sql_bucket('o_orderkey', 7)}, o_orderkey) - 1) % 5)::int as fold from orders")
def kfold_stratified(spark, d):
    return folds.kfold_stratified(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 5, seed=7)


@query("kfold_rotation", f"with f as (select o_orderkey, ({sql_bucket('o_orderkey', 7)} % 5)::int as fold from orders) select round::int as round, o_orderkey, case when fold = round then 'test' when fold = (round + 1) % 5 then 'valid' else 'train' end as part from f, range(5) t(round)")
def kfold_rotation(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", (bucket("o_orderkey", 7) % 5).cast("int").alias("fold"))
    return folds.rotation(df, "fold", 5).select("round", "o_orderkey", "part")


@query("random_split", f"select o_orderkey, case when {sql_bucket('o_orderkey', 3)} < 858993459 then 'valid' else 'train' end as by_fraction, case when row_number() over (order by {sql_bucket('o_orderkey', 3)}, o_orderkey) <= 1000 then 'valid' else 'train' end as by_size from orders")
def random_split(spark, d):
    df = read(spark, d, "orders").select("o_orderkey")
    return folds.split_by_size(folds.split_by_fraction(df, "o_orderkey", 0.2, seed=3), "o_orderkey", 1000, seed=3)


@query("index_split", f"with i as (select o_orderkey as row_no, case when {sql_bucket('o_orderkey', 1)} % 3 = 0 then 'test' else 'train' end as split from orders where o_orderkey % 2 = 0) select i.split, o.o_orderkey, o.o_totalprice from orders o join i on o.o_orderkey = i.row_no")
def index_split(spark, d):
    orders = read(spark, d, "orders")
    index = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("row_no"), F.when(bucket("o_orderkey", 1) % 3 == 0, "test").otherwise("train").alias("split"))
    return select.index_split(orders, "o_orderkey", index).select("split", "o_orderkey", "o_totalprice")
