"""Ranking statistics, error measures and error segments. Ranks run over distinct scores, never over one task of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.order import global_row_number, running_sums

TINY = 1e-15
#: Ranges that distinct scores are cut into.
RANGES = 64


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above, pos_below, neg_below) by distinct score.

    Scores are cut into RANGES; sums run within a range, and those of whole ranges before it are added.
    """
    y = F.col(label)
    counts = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum((y == 1).cast("bigint")).alias("pos"), F.sum((y != 1).cast("bigint")).alias("neg"))
    totals = counts.agg(F.sum("pos").alias("_pt"), F.sum("neg").alias("_nt"))
    out = running_sums(counts, ["score"], {"pos_below": "pos", "neg_below": "neg"}, RANGES).crossJoin(F.broadcast(totals))
    above = {"pos_above": F.col("_pt") - F.col("pos_below") - F.col("pos"), "neg_above": F.col("_nt") - F.col("neg_below") - F.col("neg")}
    return out.withColumns(above).select("score", "pos", "neg", "pos_above", "neg_above", "pos_below", "neg_below")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, folded): area by mean ranks, and the same at 0.5 or more. Null without both classes."""
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2))
    area = wins / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))
    return score_counts(df, score, label).agg(area.alias("auc")).select("auc", F.greatest("auc", 1 - F.col("auc")).alias("folded"))


def auc_by_position(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """(auc): area from the places of positives in descending order, ties in the order of the key."""
    placed = global_row_number(df.where(F.col(score).isNotNull()), -F.col(score), key, name="_place")
    y = F.col(label) == 1
    p, n = F.sum(y.cast("double")), F.sum((~y).cast("double"))
    ranks = F.sum(F.when(y, F.col("_place") + 1).otherwise(0)).cast("double")
    return placed.agg((1 + (p + 1) / (2 * n) - ranks / (p * n)).alias("auc"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, tpr, fpr): rates of rows at or above each distinct score."""
    c = score_counts(df, score, label)
    return c.select("score", ((F.col("pos_above") + F.col("pos")) / (F.col("pos") + F.col("pos_above") + F.col("pos_below"))).alias("tpr"), ((F.col("neg_above") + F.col("neg")) / (F.col("neg") + F.col("neg_above") + F.col("neg_below"))).alias("fpr"))


def youden(curve: DataFrame) -> DataFrame:
    """(score, gain): the threshold of the greatest tpr - fpr, the highest score on ties."""
    return curve.agg(F.max_by("score", F.struct(F.round(F.col("tpr") - F.col("fpr"), 9), F.col("score"))).alias("score"), F.max(F.col("tpr") - F.col("fpr")).alias("gain"))


def separation(df: DataFrame, distance: str, genuine: Column, span: int) -> DataFrame:
    """(cell, genuine, impostor): counts of distances, clamped to [0, 1], in span + 1 cells."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(distance)))
    known = df.where(F.col(distance).isNotNull())
    return known.groupBy(F.floor(d * span).cast("int").alias("cell")).agg(F.sum(genuine.cast("bigint")).alias("genuine"), F.sum((~genuine).cast("bigint")).alias("impostor"))


def separation_stats(df: DataFrame, distance: str, genuine: Column) -> DataFrame:
    """One row: moments and ends of both populations, and d' = |difference of means| / (sqrt(sum of variances) / 2)."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(distance)))
    made = []
    for name, who in (("genuine", genuine), ("impostor", ~genuine)):
        x = F.when(who, d)
        made += [F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
    out = df.agg(*made)
    spread = F.sqrt(F.pow("genuine_std", F.lit(2)) + F.pow("impostor_std", F.lit(2))) / 2
    return out.withColumn("d_prime", F.abs(F.col("genuine_mean") - F.col("impostor_mean")) / F.nullif(spread, F.lit(0.0)))


def far_frr(cells: DataFrame) -> DataFrame:
    """(cell, far, frr): impostors at or below the cell, genuine above it. There are span + 1 cells at most."""
    w, all_ = Window.orderBy("cell"), Window.partitionBy()
    return cells.select("cell", (F.sum("impostor").over(w) / F.sum("impostor").over(all_)).alias("far"), (1 - F.sum("genuine").over(w) / F.sum("genuine").over(all_)).alias("frr"))


def equal_error(curve: DataFrame, separator: float = 1e-3) -> DataFrame:
    """(cell, rate, separator_cell): the first cell with far >= frr, and the first with far over the separator."""
    return curve.agg(
        F.min(F.when(F.col("far") >= F.col("frr"), F.col("cell"))).alias("cell"),
        F.min_by((F.col("far") + F.col("frr")) / 2, F.when(F.col("far") >= F.col("frr"), F.col("cell"))).alias("rate"),
        F.min(F.when(F.col("far") > separator, F.col("cell"))).alias("separator_cell"),
    )


def frr_at(curve: DataFrame, decades: Sequence[int] = range(-7, 1)) -> DataFrame:
    """(decade, frr): frr at the last cell whose far is at most 10 ** decade; 1 where there is none."""
    cells = [F.struct(F.lit(d).alias("decade"), F.coalesce(F.max_by("frr", F.when(F.col("far") <= 10.0**d, F.col("cell"))), F.lit(1.0)).alias("frr")) for d in decades]
    return curve.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def regression_metrics(y: str, p: str) -> dict[str, Column]:
    e = F.col(y) - F.col(p)
    log = F.log1p(y) - F.log1p(p)
    return {"n": F.count(e), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "rmsle": F.sqrt(F.avg(log * log))}


def binary_metrics(y: str, p: str) -> dict[str, Column]:
    q = F.least(F.greatest(F.col(p), F.lit(TINY)), F.lit(1 - TINY))
    loss = -F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))
    return {"n": F.count(loss), "log_loss": F.avg(loss), "error_rate": F.avg(((F.col(p) > 0.5).cast("int") != F.col(y)).cast("double"))}


def multiclass_log_loss(y: str, probabilities: dict[int, str]) -> Column:
    """Mean loss; y is the class, probabilities are named by class and normalised."""
    total = sum((F.col(c) for c in probabilities.values()), F.lit(0.0))
    own = F.coalesce(*(F.when(F.col(y) == k, F.col(c)) for k, c in probabilities.items())) / total
    return F.avg(-F.log(F.least(F.greatest(own, F.lit(TINY)), F.lit(1 - TINY))))


def fold_summary(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.agg(*(e for c in names for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))))


def error_segments(df: DataFrame, y: str, p: str, features: Sequence[str]) -> DataFrame:
    """(segment, n, {feature}_mean): rows of errors above and up to a tenth of the range of errors; null features count as 0."""
    e = df.withColumn("_e", F.abs(F.col(p) - F.col(y)))
    cut = e.agg((F.min("_e") + (F.max("_e") - F.min("_e")) / 10).alias("_cut"))
    out = e.crossJoin(F.broadcast(cut)).groupBy(F.when(F.col("_e") > F.col("_cut"), "high").otherwise("low").alias("segment"))
    return out.agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}_mean") for c in features))
