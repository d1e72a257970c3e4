"""Queries of ranking statistics, error measures and blends."""

from __future__ import annotations




from pyspark.sql import functions as F

from tabloom.functions.keys import bucket
from tabloom.jobs.registry import query, read
from tabloom.operators import blend, evaluate, scalar

S = "with s as (select event_id as id, value as s, (event_type = 'purchase')::int as y from events)"
P = "with p as (select event_id as id, (event_type = 'purchase')::int as y, least(value / 200, 1.0) as p, (('0x'||substr(md5('0:'||event_id::varchar),1,8))::bigint % 5)::int as fold from events)"


def scores(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("s"), (F.col("event_type") == "purchase").cast("int").alias("y"))


def predicted(spark, d):
    p = F.least(F.col("value") / 200, F.lit(1.0))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").cast("int").alias("y"), p.alias("p"), (bucket("event_id") % 5).cast("int").alias("fold"))


def rounded(df, places=8):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


@query("auc_ranksum", S + ", r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from s), a as (select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0))::double as auc from r) select round(auc, 8) as auc, round(greatest(auc, 1 - auc), 8) as folded from a")
def auc_ranksum(spark, d):
    return rounded(evaluate.auc(scores(spark, d), "s", "y"))


@query("auc_position", S + ", r as (select y, row_number() over (order by s desc, id) as k from s) select round(1 + (sum(y) + 1) / (2 * sum(1 - y))::double - sum(k) filter (y = 1) / (sum(y) * sum(1 - y))::double, 8) as auc from r")
def auc_position(spark, d):
    return rounded(evaluate.auc_by_position(scores(spark, d), "s", "y", "id"))


_ROC = ", c as (select s as score, sum(y) as pos, sum(1 - y) as neg from s group by 1), r as (select score, sum(pos) over w / sum(pos) over () as tpr, sum(neg) over w / sum(neg) over () as fpr from c window w as (order by score desc))"


@query("roc_curve", S + _ROC + " select score, round(tpr, 8) as tpr, round(fpr, 8) as fpr from r")
def roc_curve(spark, d):
    return rounded(evaluate.roc_curve(scores(spark, d), "s", "y"))


@query("youden_threshold", S + _ROC + " select score, round(tpr - fpr, 8) as gain from r order by round(tpr - fpr, 9) desc, score desc limit 1")
def youden_threshold(spark, d):
    return rounded(evaluate.youden(evaluate.roc_curve(scores(spark, d), "s", "y")))


_D = "with d as (select least(greatest((l_discount * 10 + l_quantity / 50) / 2 + case when l_returnflag = 'R' then -0.2 else 0.05 end, 0.0), 1.0) as x, l_returnflag = 'R' as g from lineitem)"


def distances(spark, d):
    x = (F.col("l_discount") * 10 + F.col("l_quantity") / 50) / 2 + F.when(F.col("l_returnflag") == "R", -0.2).otherwise(0.05)
    return read(spark, d, "lineitem").select(x.alias("x"), (F.col("l_returnflag") == "R").alias("g"))


@query("separation_stats", _D + ", m as (select avg(x) filter (g) as genuine_mean, stddev_pop(x) filter (g) as genuine_std, min(x) filter (g) as genuine_min, max(x) filter (g) as genuine_max, avg(x) filter (not g) as impostor_mean, stddev_pop(x) filter (not g) as impostor_std, min(x) filter (not g) as impostor_min, max(x) filter (not g) as impostor_max from d) select " + ", ".join(f"round({w}_{k}, 6) as {w}_{k}" for w in ("genuine", "impostor") for k in ("mean", "std", "min", "max")) + ", round(abs(genuine_mean - impostor_mean) / (sqrt(genuine_std * genuine_std + impostor_std * impostor_std) / 2), 6) as d_prime from m")
def separation_stats(spark, d):
    return rounded(evaluate.separation_stats(distances(spark, d), "x", F.col("g")), 6)


_CURVE = _D + ", c as (select floor(x * 100)::int as cell, count(*) filter (g) as gen, count(*) filter (not g) as imp from d group by 1), r as (select cell, sum(imp) over w / sum(imp) over () as far, 1 - sum(gen) over w / sum(gen) over () as frr from c window w as (order by cell))"


def curve(spark, d):
    return evaluate.far_frr(evaluate.separation(distances(spark, d), "x", F.col("g"), 100))


@query("far_frr_curve", _CURVE + " select cell, round(far, 8) as far, round(frr, 8) + 0.0 as frr from r")
def far_frr_curve(spark, d):
    return curve(spark, d).select("cell", F.round("far", 8).alias("far"), (F.round("frr", 8) + 0.0).alias("frr"))


@query("equal_error_rate", _CURVE + " select (select min(cell) from r where far >= frr) as cell, round((select (far + frr) / 2 from r where far >= frr order by cell limit 1), 8) as rate, (select min(cell) from r where far > 0.001) as separator_cell")
def equal_error_rate(spark, d):
    return rounded(evaluate.equal_error(curve(spark, d)))


@query("frr_at_far", _CURVE + " select t.decade::int as decade, round(coalesce((select frr from r where far <= pow(10, t.decade) order by cell desc limit 1), 1), 8) + 0.0 as frr from range(-7, 1) t(decade)")
def frr_at_far(spark, d):
    return evaluate.frr_at(curve(spark, d)).select("decade", (F.round("frr", 8) + 0.0).alias("frr"))


@query("metrics_regression", "select coalesce(f, 'all') as fold, count(*) as n, round(avg(e * e), 2) as mse, round(sqrt(avg(e * e)), 5) as rmse, round(avg(abs(e)), 5) as mae, round(sqrt(avg(l * l)), 7) as rmsle from (select (o_orderkey % 3)::varchar as f, o_totalprice - 150000 as e, ln(1 + o_totalprice) - ln(150001) as l from orders) group by grouping sets ((f), ())")
def metrics_regression(spark, d):
    df = read(spark, d, "orders").select((F.col("o_orderkey") % 3).cast("string").alias("fold"), F.col("o_totalprice").alias("y"), F.lit(150000.0).alias("p"))
    m = [c.alias(k) for k, c in evaluate.regression_metrics("y", "p").items()]
    out = df.groupBy("fold").agg(*m).unionByName(df.agg(*m).withColumn("fold", F.lit("all")))
    return out.select("fold", "n", F.round("mse", 2).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("rmsle", 7).alias("rmsle"))


_LOSS = "-case when y = 1 then ln(least(greatest(p, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end"


@query("metrics_binary", P + f" select fold, count(*) as n, round(avg({_LOSS}), 6) as log_loss, round(avg((((p > 0.5)::int) <> y)::int), 8) as error_rate from p group by 1")
def metrics_binary(spark, d):
    out = predicted(spark, d).groupBy("fold").agg(*(c.alias(k) for k, c in evaluate.binary_metrics("y", "p").items()))
    return out.select("fold", "n", F.round("log_loss", 6).alias("log_loss"), F.round("error_rate", 8).alias("error_rate"))


@query("metrics_multiclass", "select round(avg(-ln(least(greatest(case o_orderstatus when 'F' then a when 'O' then b else c end / (a + b + c), 1e-15), 1 - 1e-15))), 7) as log_loss from (select o_orderstatus, 1 + o_custkey % 3 as a, 2.0 as b, 0.5 + o_orderkey % 2 as c from orders)")
def metrics_multiclass(spark, d):
    df = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"), (1 + F.col("o_custkey") % 3).alias("a"), F.lit(2.0).alias("b"), (0.5 + F.col("o_orderkey") % 2).alias("c"))
    return df.agg(F.round(evaluate.multiclass_log_loss("y", {0: "a", 1: "b", 2: "c"}), 7).alias("log_loss"))


@query("fold_summary", P + f", f as (select fold, avg({_LOSS}) as l from p group by 1) select round(avg(l), 6) as log_loss_mean, round(stddev_pop(l), 6) as log_loss_std, (select round(avg({_LOSS}), 6) from p) as overall from f")
def fold_summary(spark, d):
    p = predicted(spark, d)
    loss = evaluate.binary_metrics("y", "p")["log_loss"]
    overall = p.agg(F.round(loss, 6).alias("overall"))
    return rounded(evaluate.fold_summary(p.groupBy("fold").agg(loss.alias("log_loss")), ["log_loss"]), 6).crossJoin(F.broadcast(overall))


@query("predict_label", P + " select id, case when p > 0.5 then 'purchase' else 'other' end as label, round(1 - p, 9) as p0, round(p, 9) as p1 from p")
def predict_label(spark, d):
    from tabloom.operators.model import label_of

    return predicted(spark, d).select("id", label_of(F.col("p"), "other", "purchase").alias("label"), F.round(1 - F.col("p"), 9).alias("p0"), F.round("p", 9).alias("p1"))


@query("error_segments", "with e as (select abs(o_totalprice - 150000) as e, o_custkey, case when o_orderkey % 7 <> 0 then o_orderkey % 11 end as k from orders), c as (select min(e) + (max(e) - min(e)) / 10 as cut from e) select case when e > cut then 'high' else 'low' end as segment, count(*) as n, round(avg(o_custkey), 6) as o_custkey_mean, round(avg(coalesce(k, 0)), 8) as k_mean from e, c group by 1")
def error_segments(spark, d):
    df = read(spark, d, "orders").select(F.col("o_totalprice").alias("y"), F.lit(150000.0).alias("p"), "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 11).alias("k"))
    out = evaluate.error_segments(df, "y", "p", ["o_custkey", "k"])
    return out.select("segment", "n", F.round("o_custkey_mean", 6).alias("o_custkey_mean"), F.round("k_mean", 8).alias("k_mean"))


M = "with m as (select o_orderkey as id, 1 + o_totalprice / 1000 as p0, 2 + o_custkey / 10 as p1, 3.0 + o_orderkey % 50 as p2 from orders)"


def models(spark, d):
    orders = read(spark, d, "orders")
    made = (1 + F.col("o_totalprice") / 1000, 2 + F.col("o_custkey") / 10, 3.0 + F.col("o_orderkey") % 50)
    return [orders.select(F.col("o_orderkey").alias("id"), c.alias("p")) for c in made]


def blended(spark, d, rule):
    wide, names = blend.aligned(models(spark, d), "id", "p")
    return wide.select("id", scalar.rounded(rule(names), 6).alias("p"))


@query("blend_log_mean", M + " select id, round(exp((ln(p0) + ln(p1) + ln(p2)) / 3), 6) as p from m")
def blend_log_mean(spark, d):
    return blended(spark, d, blend.log_mean)


@query("blend_h_mean", M + " select id, round(1 / (1 / p0 + 1 / p1 + 1 / p2), 6) as p from m")
def blend_h_mean(spark, d):
    return blended(spark, d, blend.harmonic)


@query("blend_max", M + " select id, round(greatest(p0, p1, p2), 6) as p from m")
def blend_max(spark, d):
    return blended(spark, d, blend.row_max)


@query("mix_columns", M + " select id, round(ln(exp(p0 / 100) + exp(p1 / 100) + exp(p2 / 100)), 6) as exp_mean, round(1 / (1 / p0 + 1 / p1 + 1 / p2), 6) as h_mean, round(greatest(p0, p1, p2), 6) as top from m")
def mix_columns(spark, d):
    wide, names = blend.aligned(models(spark, d), "id", "p")
    # As the SQL (and the reference) has it, without the shift: sums of exponentials that no double holds are infinite.
    small = wide.select("id", *names, *((F.col(n) / 100).alias(f"s{n}") for n in names))
    mixed = {"exp_mean": blend.log_sum_exp([f"s{n}" for n in names], shifted=False), "h_mean": blend.harmonic(names), "top": blend.row_max(names)}
    return small.select("id", *(scalar.rounded(c, 6).alias(k) for k, c in mixed.items()))


@query("blend_weighted", M + " select id, floor(0.5 * p0 + 0.3 * p1 + 0.2 * p2 + 1e-7)::bigint as p from m")
def blend_weighted(spark, d):
    wide, _ = blend.aligned(models(spark, d), "id", "p")
    return wide.select("id", F.floor(blend.weighted({"p0": 0.5, "p1": 0.3, "p2": 0.2}) + 1e-7).alias("p"))


@query("ensemble_mean", M + " select id, round((p0 + p1 + p2) / 3, 6) as p from m")
def ensemble_mean(spark, d):
    return blended(spark, d, lambda names: sum((F.col(n) for n in names), F.lit(0.0)) / len(names))


@query("tail_adjust", "with q as (select quantile_cont(o_totalprice, 0.0042) as a, quantile_cont(o_totalprice, 0.99) as b from orders), l as (select o_orderkey, case when o_totalprice < a then o_totalprice * 0.77 else o_totalprice end as p, b from orders, q) select o_orderkey, round(case when p >= b then p * 1.1 else p end, 4) as p from l")
def tail_adjust(spark, d):
    return blend.tail_adjust(read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p")), "p").select("o_orderkey", F.round("p", 4).alias("p"))


_SIX = [f"t{k}" for k in range(6)]


@query("multi_target_long", " union all ".join(f"select o_orderkey || '_{k}' as target_id, round(o_totalprice * {k + 1}, 4) as target from orders" for k in range(6)))
def multi_target_long(spark, d):
    from tabloom.operators.model import long_targets

    wide = read(spark, d, "orders").select("o_orderkey", *((F.col("o_totalprice") * (k + 1)).alias(t) for k, t in enumerate(_SIX)))
    return long_targets(wide, "o_orderkey", _SIX).select("target_id", F.round("target", 4).alias("target"))


@query("submission_format", "select o_orderkey as id, printf('%.4f', o_totalprice / 7) as target from orders")
def submission_format(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("%.4f", F.col("o_totalprice") / 7).alias("target"))


