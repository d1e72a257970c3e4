"""Whole jobs: a feature stage that SQL can check, and models over it with errors on rows that they have not seen.

Three kinds of data: readings of meters with group statistics, wide categories with several targets, and a binary target
with a holdout in time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.jobs import meters
from tabloom.jobs.registry import query, read
from tabloom.operators import encode, evaluate, folds, merge, model, order, scalar, select, skew, stats
from tabloom.sources import files
from tabloom.sources.staging import place, staged

#: Parameters of the pipelines' boosters.
GIVEN = {"num_boost_round": 4, "learning_rate": 0.3, "max_depth": 3, "max_bin": 32, "early_stop": 3, "metric": "rmse"}


@query("readings_features", """
with r as (select l_orderkey, l_linenumber, l_quantity, l_returnflag as meter, o_orderpriority, ln(1 + l_extendedprice) as y, month(l_shipdate) as month, (isodow(l_shipdate) - 1)::int as weekday
  from lineitem left join orders on l_orderkey = o_orderkey where not coalesce(l_returnflag = 'A' and l_linenumber = 1 and l_quantity < 10, false)),
s as (select meter, month, avg(y) as m, median(y) as d from r group by all),
t as (select meter, month, weekday, avg(y) as m, median(y) as d from r group by all)
select l_orderkey, l_linenumber, l_quantity, r.meter, o_orderpriority, r.month, r.weekday, round(y, 6) as y, round(s.m, 5) as month_mean, round(s.d, 5) as month_median, round(t.m, 5) as day_mean, round(t.d, 5) as day_median
from r join s on r.meter = s.meter and r.month = s.month join t on r.meter = t.meter and r.month = t.month and r.weekday = t.weekday""")
def readings_features(spark, d):
    """Readings with their building's data, without a bad stretch, with time parts and statistics of two key sets."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    fact = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("meter"), F.log1p("l_extendedprice").alias("y"), "l_shipdate")
    r = select.drop_where(fact.join(orders.hint("shuffle_hash"), "l_orderkey", "left"), (F.col("meter") == "A") & (F.col("l_linenumber") == 1) & (F.col("l_quantity") < 10))
    r = r.withColumns({"month": F.month("l_shipdate"), "weekday": scalar.time_parts("l_shipdate")["weekday"]}).drop("l_shipdate")
    r = known = staged(r)
    for prefix, keys in (("month", ["meter", "month"]), ("day", ["meter", "month", "weekday"])):
        fitted = merge.fit_group_stats(known, keys, "y", prefix)
        r = merge.apply_group_stats(r, fitted.select(*keys, *(F.round(c, 5).alias(c) for c in (f"{prefix}_mean", f"{prefix}_median"))), keys)
    return r.withColumn("y", scalar.rounded("y", 6)).select("l_orderkey", "l_linenumber", "l_quantity", "meter", "o_orderpriority", "month", "weekday", "y", "month_mean", "month_median", "day_mean", "day_median")


#: Weather columns that the readings job keeps, and bins in which it screens them.
KEPT_WEATHER, SCREEN_BINS = 3, 16


def screened(facts, dim, keys, target, columns, most):
    """The `most` columns of a dimension that tell the target's variance best over its facts, by bins, without the wide join."""
    counts = staged(facts.groupBy(*keys).agg(F.count("*").alias("_facts")))
    found = model.side_by_side([lambda c=c: merge.weighted_edges(counts, dim, keys, c, SCREEN_BINS, "_facts") for c in columns])
    edges = dict(zip(columns, found, strict=True))
    cells = merge.merged_histogram(facts, dim, keys, target, edges, "screen").where("n > 0")
    gain = F.sum(F.col("sum_y") * F.col("sum_y") / F.col("n")) - F.sum("sum_y") * F.sum("sum_y") / F.sum("n")
    return [r["feature"] for r in cells.groupBy("feature").agg(gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(most).collect()]


@query("pipeline_readings")
def pipeline_readings(spark, d):
    """(fold, n, rmse, mean_rmse): errors of boosters over contiguous folds and, as fold -1, of the file that is written.

    Weather with gaps filled and lags; its row's number in each reading; its columns screened by bins without the wide
    join, and the best joined; statistics of meters by month and weekday, from train; narrow types; logs of the target; a
    booster for each fold; test rows scored by the mean of all, the logs undone, and the file written, as compressed CSV.
    Errors of folds are of the logs, that of the file is of the logs of what it holds. mean_rmse is that of train's mean.
    """
    air = staged(meters.weather(spark, d))
    rows = staged(meters.meters(spark, d, air).withColumn("y", F.log1p("reading")))
    train = rows.where("split = 'train'")
    numbered = staged(merge.numbered_dimension(air, ["site", "day"]).withColumn("weather_no", F.col("row_no").cast("int")).drop("row_no", "site", "day"))
    best = screened(train, numbered, ["weather_no"], "y", meters.WEATHER, KEPT_WEATHER)
    r = skew.checked_join(rows, numbered.select("weather_no", *best), ["weather_no"])
    for prefix, keys in (("month", ["meter", "month"]), ("day", ["meter", "weekday"])):
        r = merge.apply_group_stats(r, merge.fit_group_stats(train, keys, "y", prefix), keys)
    r = staged(encode.apply_codes(r, encode.fit_labels(train, "meter"), "meter", "meter_code", -1, check=True))
    numbers = ["quantity", "month", "weekday", "meter_code", "month_mean", "month_median", "day_mean", "day_median", *best]
    r = select.apply_types(r, select.narrow_types(r, numbers))
    data = staged(model.assembled(r, numbers).select("l_orderkey", "l_linenumber", "split", F.col("y").alias("label"), "features"))
    known = data.where("split = 'train'")
    test = staged(order.global_row_number(data.where("split = 'test'"), "l_orderkey", "l_linenumber"))
    own, told = model.out_of_fold(staged(folds.kfold_contiguous(known, "l_orderkey", 3)), model.fit_weighted("regression", GIVEN), 3, test=test, kind="regression")
    files.write_submission(told.withColumn("reading", scalar.unlog("score")), path := place(spark), "row_no", "reading")
    sent = files.read_csv(spark, path, "id bigint, target double").select(F.col("id").alias("row_no"), F.log1p("target").alias("score"))
    filed = test.join(sent, "row_no", "left").select(F.lit(-1).alias("fold"), "label", "score")
    mean = known.agg(F.avg("label").alias("_mean"))
    e, g = F.col("score") - F.col("label"), F.col("_mean") - F.col("label")
    scored = own.select("fold", "label", "score").unionByName(filed).crossJoin(F.broadcast(mean))  # one row
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(g * g)).alias("mean_rmse"))


STOPS = [f"t{k}" for k in range(3)]


@query("stops_features", """
with p as (select p_partkey, string_split_regex(trim(p_name), '\\s+')[1] as first, p_brand as brand, p_size as size, p_retailprice as price,
    case when contains(p_type, 'STEEL') then 'hard' when contains(p_type, 'TIN') then 'soft' end as kind from part),
c as (select brand as b, count(*) as n from p group by 1)
select p_partkey, kind, case when n > 20 then brand else 'Other' end as common, brand || '_' || size as crossed,
  round(count(*) over (partition by brand) / count(*) over (), 8) as brand_freq, round(count(*) over (partition by first) / count(*) over (), 8) as first_freq,
  round(avg(price) over (partition by brand), 7) as price_brand_mean, round(coalesce(stddev_samp(price) over (partition by brand), -1), 4) as price_brand_std,
  (dense_rank() over (order by first) - 1)::int as first_code,
  greatest(1, least(30, ceil((price - min(price) over ()) * 30 / (max(price) over () - min(price) over ()))))::int as price_bin
from p left join c on brand = b""")
def stops_features(spark, d):
    """Categories by words, rare levels, crosses, frequencies, statistics by key, codes and bins."""
    p = read(spark, d, "part").select("p_partkey", encode.token("p_name", 0).alias("first"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), encode.keyword_class("p_type", [("STEEL", "hard"), ("TIN", "soft")], "hard").alias("kind"))
    common = encode.collapse_rare(p, "brand", 20).select("p_partkey", F.col("brand").alias("common"))
    none = p.limit(0)
    p = encode.apply_frequency(p, encode.fit_frequency(p, none, ["brand", "first"]), ["brand", "first"])
    p = encode.apply_codes(stats.group_encode(p, "brand", ["price"]), encode.fit_factors(p, none, "first"), "first", "first_code", -1)
    ends = p.agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    p = p.crossJoin(F.broadcast(ends)).withColumns({"price_bin": stats.equal_width_bin(F.col("price"), F.col("_lo"), F.col("_hi"), 30), "crossed": encode.cross("brand", "size")})
    rounded = {"brand_freq": 8, "first_freq": 8, "price_brand_mean": 7, "price_brand_std": 4}
    return p.join(common, "p_partkey").select("p_partkey", "kind", "common", "crossed", *(F.round(c, n).alias(c) for c, n in rounded.items()), "first_code", "price_bin")


@query("pipeline_stops")
def pipeline_stops(spark, d):
    """(target_id, target): scores of three targets for the parts held out, fitted over the same folds of the others."""
    made = read(spark, d, "part").select("p_partkey", *((F.log1p("p_retailprice") * (k + 1) + F.col("p_size") * k).alias(t) for k, t in enumerate(STOPS)))
    numbers = ["brand_freq", "first_freq", "price_brand_mean", "price_brand_std", "first_code", "price_bin"]
    data = staged(model.assembled(stops_features(spark, d).join(made, "p_partkey"), numbers).select("p_partkey", *STOPS, "features"))
    train = folds.kfold_shuffled(data.where("p_partkey % 5 <> 0"), "p_partkey", 3)
    return model.fit_targets(train, data.where("p_partkey % 5 = 0"), STOPS, model.fit_weighted("regression", GIVEN), 3, "p_partkey", kind="regression")[1]


@query("binary_features", """
with e as (select event_id, user_id, value, (event_type = 'purchase')::int as y, hour(ts)::int as hour, date_diff('day', date '1970-01-01', ts::date)::int as block from events),
b as (select *, case when block = max(block) over () then 'test' when block < max(block) over () - 1 then 'train' end as split from e),
m as (select user_id as u, sum(y) / count(*) as mean from b where split = 'train' group by 1 having count(*) > 1),
o as (select avg(y) as overall from b where split = 'train')
select event_id, split, y, hour, round(value, 6) as value, round(coalesce(mean, overall), 8) as user_mean, count(*) over (partition by user_id) as user_id_counts from b left join m on user_id = u, o""")
def binary_features(spark, d):
    """A binary target with the last block held out after a gap, means of the target by id from train, and counts."""
    block = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    e = read(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "purchase").cast("int").alias("y"), F.hour("ts").alias("hour"), block.alias("block"))
    b = encode.count_encode(select.holdout_with_gap(e, "block"), "user_id")
    b = encode.apply_target_mean(b, encode.fit_target_mean(b.where("split = 'train'"), "user_id", "y"), "user_id", "user_mean")
    return b.select("event_id", "split", "y", "hour", F.round("value", 6).alias("value"), F.round("user_mean", 8).alias("user_mean"), "user_id_counts")


@query("pipeline_binary")
def pipeline_binary(spark, d):
    """(rounds, n, auc, threshold): a booster stopped on its area under the curve over a fold, scored on the held-out block."""
    data = staged(model.assembled(binary_features(spark, d).withColumn("label", F.col("y").cast("double")), ["hour", "value", "user_mean", "user_id_counts"]).select("event_id", "split", "label", "features"))
    train = folds.kfold_shuffled(data.where("split = 'train'"), "event_id", 4)
    fitted, best, _ = model.fit_early("binary", GIVEN | {"metric": "auc"}, train.where("fold <> 0"), train.where("fold = 0"))
    scored = model.score(fitted, data.where("split = 'test'")).select("label", "score")
    top = evaluate.youden(evaluate.roc_curve(scored, "score", "label")).select(F.col("score").alias("threshold"))
    found = evaluate.auc(scored, "score", "label").select("auc").crossJoin(top).crossJoin(scored.agg(F.count("*").alias("n")))  # one row each
    return found.select(F.lit(best).alias("rounds"), "n", "auc", "threshold")
