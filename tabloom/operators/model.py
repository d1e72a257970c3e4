"""Boosted trees and linear models on Spark ML, with folds, early stopping, cascades and stacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.order import first_place, held, numbers

# Defaults of parameters, and the names that each goes by, the first given one winning.
PARAMETERS: dict[str, tuple[Any, tuple[str, ...]]] = {
    "learning_rate": (0.1, ("learning_rate",)),
    "num_leaves": (31, ("num_leaves",)),
    "max_depth": (-1, ("max_depth",)),
    "max_bin": (256, ("max_bin",)),
    "min_data_in_leaf": (20, ("min_data_in_leaf",)),
    "lambda_l2": (0.0, ("lambda_l2", "reg_lambda")),
    "subsample": (1.0, ("subsample", "bagging_fraction", "sub_row")),
    "sub_feature": (1.0, ("feature_sample", "feature_fraction", "sub_feature", "colsample_bytree")),
    "early_stop": (50, ("early_stop", "early_stopping_round", "early_stopping_rounds", "early_stopping")),
    "num_trees": (50, ("num_boost_round", "num_iterations", "num_iteration", "num_tree", "num_trees", "num_round", "num_rounds", "n_estimators")),
}
METRICS = {
    "regression_l2": "mse", "mse": "mse", "l2": "mse",
    "regression_l1": "mae", "mean_absolute_error": "mae", "mae": "mae", "l1": "mae",
    "mean_squared_error": "rmse", "l2_root": "rmse", "root_mean_squared_error": "rmse", "rmse": "rmse",
}
#: Seed of all fits, which is no parameter.
SEED = 42
#: Fits that run side by side.
SIDE_BY_SIDE = 4
#: Name of the column that says how many rows a cell stands for.
WEIGHT = "_weight"
#: Depth where none is given, and the deepest that Spark ML grows.
DEPTH, MOST_DEPTH = 5, 30


def parameters(given: dict[str, Any]) -> dict[str, Any]:
    """All parameters: of the names given for one, the first in order wins, cast as its default. Unknown names are ignored."""
    out = {name: type(default)(next((given[a] for a in aliases if a in given), default)) for name, (default, aliases) in PARAMETERS.items()}
    return out | {"metric": METRICS.get(given.get("metric", "mse"), given.get("metric", "mse"))}


def booster(kind: str, given: dict[str, Any], label: str = "label", rounds: int | None = None):
    """A Spark ML booster for regression or binary classes."""
    p = parameters(given)
    depth = DEPTH if p["max_depth"] < 0 else min(p["max_depth"], MOST_DEPTH)
    share = p["sub_feature"]
    make = GBTRegressor if kind == "regression" else GBTClassifier
    return make(
        labelCol=label, featuresCol="features", maxIter=rounds or p["num_trees"], stepSize=p["learning_rate"], maxBins=p["max_bin"], minInstancesPerNode=p["min_data_in_leaf"],
        subsamplingRate=p["subsample"], featureSubsetStrategy="all" if share >= 1 else str(share), maxDepth=depth, seed=SEED, cacheNodeIds=True, checkpointInterval=10,
    )


def cells(df: DataFrame, kind: str, label: str = "label", by: Sequence[str] = (), of: Sequence[str] = ()) -> DataFrame:
    """(features, by, label, WEIGHT): df with equal features summed up, for fits that weigh rows.

    With `of`, the names of numbers, these stand in place of features, which assembled() then makes of cells and not of rows.

    Of classes there is one row for each label. Of a regression there are two, at the mean of the labels less and plus their
    deviation, each of half the weight: number, sum and sum of squares stay, which is all that squared errors need. So the
    table grows with different features, not with rows. A null label becomes NaN, which fits refuse.
    """
    y = F.coalesce(F.col(label).cast("double"), F.lit(float("nan")))
    same = [F.col(c).cast("double").alias(c) for c in of] or ["features"]
    if kind != "regression":
        return df.groupBy(*same, *by, y.alias(label)).agg(F.count("*").cast("double").alias(WEIGHT))
    sums = df.groupBy(*same, *by).agg(F.count("*").cast("double").alias("_n"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_std"))
    point = lambda at, n: F.struct(at.alias(label), n.alias(WEIGHT))
    mean, std, n = F.col("_mean"), F.col("_std"), F.col("_n")
    points = F.when(std > 0, F.array(point(mean - std, n / 2), point(mean + std, n / 2))).otherwise(F.array(point(mean, n)))
    return sums.select(*(of or ["features"]), *by, F.inline(points))


def compact(df: DataFrame, kind: str, given: dict[str, Any], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """cells(), or rows of weight 1 where trees take a share of the rows. What has WEIGHT is made of cells already."""
    share = parameters(given)["subsample"] < 1
    if WEIGHT in df.columns:
        if share:
            raise ValueError("trees of a share of the rows take rows and no cells")
        return df
    if share:
        return df.select("features", *by, label, F.lit(1.0).alias(WEIGHT))
    return cells(df, kind, label, by)


def weighted(estimator, rows: DataFrame, least: int):
    """The estimator for rows with WEIGHT: `least` is the number of rows in a leaf, which weights count."""
    n = rows.agg(F.sum(WEIGHT)).first()[0] or 0.0
    out = estimator.copy().setWeightCol(WEIGHT)
    if n < 2 * least:
        return out.setMinInstancesPerNode(2**31 - 1)  # no split leaves so many on both sides
    return out.setMinInstancesPerNode(1).setMinWeightFractionPerNode(max(least - 0.5, 0.0) / n)


def fit_weighted(kind: str, given: dict[str, Any], label: str = "label", rounds: int | None = None) -> Callable[[DataFrame], Any]:
    """A fit of a booster on rows with WEIGHT."""
    made, least = booster(kind, given, label, rounds), parameters(given)["min_data_in_leaf"]
    return lambda rows: weighted(made, rows, least).fit(rows)


@dataclass(frozen=True)
class Features:
    """The columns of a vector, in order; of categorical ones the levels in order, of discrete ones the values in order."""

    names: tuple[str, ...]
    levels: dict[str, list[str]] = field(default_factory=dict)
    values: dict[str, list[float]] = field(default_factory=dict)


def named(features: Sequence[str], chosen: Sequence[str | int]) -> list[str]:
    """Columns that are given by name or by place."""
    out = [features[c] if isinstance(c, int) else c for c in chosen]
    if unknown := sorted(set(out) - set(features)):
        raise ValueError(f"no features: {', '.join(unknown)}")
    return list(dict.fromkeys(out))


def fit_features(train: DataFrame, features: Sequence[str], categorical: Sequence[str | int] = (), discrete: Sequence[str | int] = (), max_bin: int = 256) -> Features:
    """Levels and values of the columns named (or placed) so, from one pass over train.

    A booster splits a categorical column by sets of its levels, and a discrete one, which is a number, between any two of
    its values. Both need a bin for each, and a categorical one a bin more for nulls and levels that train has not: a
    column with too many is an error.
    """
    sets, steps = named(features, categorical), named(features, discrete)
    if both := sorted(set(sets) & set(steps)):
        raise ValueError(f"categorical and discrete: {', '.join(both)}")
    if not sets and not steps:
        return Features(tuple(features))
    cells = train.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") if c in steps else F.col(c)).cast("string").alias("level")) for c in [*sets, *steps]))))
    distinct = cells.where("level is not null").distinct()
    room = {c: max_bin - (c in sets) for c in [*sets, *steps]}
    for r in distinct.groupBy("column").count().collect():  # a row for each column
        if r["count"] > room[r["column"]]:
            raise ValueError(f"{r['column']} has {r['count']} levels; max_bin = {max_bin} leaves room for {room[r['column']]}")
    found: dict[str, list[str]] = {c: [] for c in room}
    for r in distinct.collect():  # max_bin rows for each column at most
        found[r["column"]].append(r["level"])
    return Features(tuple(features), {c: sorted(found[c], key=lambda v: v.encode()) for c in sets}, {c: sorted(map(float, found[c])) for c in steps})


def _slot(c: str, levels: Sequence[str]) -> Column:
    """A level's place, by a binary search; one past the last for nulls and other levels. The column says how many slots there are."""
    x, known = F.col(c).cast("string"), F.array(*map(F.lit, levels)).cast("array<string>")
    at = first_place(len(levels), lambda k: F.get(known, k) < x) if levels else F.lit(0)
    rest = "other"
    while rest in levels:
        rest += "_"
    slot = F.when(F.get(known, at) == x, at).otherwise(len(levels)).cast("double")
    return slot.alias(f"_f_{c}", metadata={"ml_attr": {"type": "nominal", "name": c, "vals": [*levels, rest]}})


def _step(c: str, values: Sequence[float]) -> Column:
    """The place of the greatest known value at or below a value; -1 for nulls and what lies below all."""
    x = F.col(c).cast("double")
    at = first_place(len(values), lambda k: F.get(numbers(values), k) <= x) if values else F.lit(0)
    return (F.when(x.isNotNull(), at).otherwise(0) - 1).cast("double").alias(f"_f_{c}")


def assembled(df: DataFrame, features: Sequence[str] | Features) -> DataFrame:
    """Adds features; a null number counts as 0. Categorical columns are marked as such in the vector's attributes."""
    made = features if isinstance(features, Features) else Features(tuple(features))

    def cell(c: str) -> Column:
        if c in made.levels:
            return _slot(c, made.levels[c])
        return _step(c, made.values[c]) if c in made.values else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f_{c}")

    clean = df.select("*", *map(cell, made.names))
    return VectorAssembler(inputCols=[f"_f_{c}" for c in made.names], outputCol="features").transform(clean).drop(*(f"_f_{c}" for c in made.names))


@dataclass
class Fitted:
    """A booster with the features that it was fitted on."""

    features: Features
    model: Any
    rounds: int
    errors: list[float]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the value, or the probability of class 1; levels that the fit has not seen share a slot with nulls."""
        return score(self.model, assembled(df, self.features), name).drop("features")


def fit_model(
    kind: str, given: dict[str, Any], train: DataFrame, features: Sequence[str], label: str = "label", valid: DataFrame | None = None, categorical: Sequence[str | int] = (), discrete: Sequence[str | int] = ()
) -> Fitted:
    """A booster of `kind` regression or binary, stopped early on valid if it is given; categorical and discrete columns by name or place."""
    p = parameters(given)
    made = fit_features(train, features, categorical, discrete, p["max_bin"])
    data = assembled(train, made)
    if valid is not None:
        return Fitted(made, *fit_early(kind, given, data, assembled(valid, made), label))
    with held(data) as rows:
        return Fitted(made, booster(kind, given, label).fit(rows), p["num_trees"], [])


def side_by_side(jobs: Sequence[Callable[[], Any]], most: int = SIDE_BY_SIDE) -> list[Any]:
    """Results of jobs that submit work of their own, `most` at a time, each in a scheduler pool of its own."""
    spark = SparkSession.active()
    passed_on = inheritable_thread_target(spark)

    def run(k: int, job: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fits-{k % most}")
        return job()

    with ThreadPoolExecutor(max(1, min(most, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(passed_on(run), k, job) for k, job in enumerate(jobs)]]


def round_errors(model, valid: DataFrame, metric: str, label: str = "label", weight: str | None = None) -> list[float]:
    """The metric on valid after each round; the area under the curve is negated, so that less is better for all.

    A model that was fitted on weights wants them in valid, too; `weight` is their column.
    """
    if metric in ("mse", "rmse", "mae"):
        found = model.evaluateEachIteration(valid, "absolute" if metric == "mae" else "squared") if isinstance(model, GBTRegressionModel) else model.evaluateEachIteration(valid)
        return [e**0.5 for e in found] if metric == "rmse" else list(found)
    if isinstance(model, GBTRegressionModel):
        raise ValueError(f"{metric} is no metric of a regression")
    if metric in ("binary_logloss", "logloss", "binary"):
        return [e / 2 for e in model.evaluateEachIteration(valid)]  # the loss is counted twice there
    if metric != "auc":
        raise ValueError(f"unknown metric {metric}")
    margin, columns, extra = F.lit(0.0), {}, [weight] if weight else []
    scored = valid.select("features", label, *extra)
    for k, (tree, share) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        scored = tree.setPredictionCol(f"_t{k}").transform(scored)
        margin = margin + F.col(f"_t{k}") * share
        columns[f"_m{k}"] = margin
    with held(scored.select(label, *extra, *(c.alias(n) for n, c in columns.items()))) as margins:
        area = lambda n: BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=n, metricName="areaUnderROC", numBins=0, weightCol=weight).evaluate(margins)
        return [-area(n) for n in columns]


def fit_early(kind: str, given: dict[str, Any], train: DataFrame, valid: DataFrame, label: str = "label"):
    """(model, best round, errors): the model of the round that is best on valid, by the given metric, before patience ends.

    Both may be cells() of one table that the caller holds, so that its rows are passed over once.
    """
    p, rows = parameters(given), compact(train, kind, given, label)
    # Absolute errors need every label, all other metrics what cells keep.
    if WEIGHT in valid.columns:
        if p["metric"] == "mae":
            raise ValueError("mae takes rows and no cells")
        known = valid
    else:
        known = valid.withColumn(WEIGHT, F.lit(1.0)) if p["metric"] == "mae" else cells(valid, kind, label)
    with nullcontext(rows) if WEIGHT in train.columns else held(rows) as data:
        model = fit_weighted(kind, given, label)(data)
        errors = round_errors(model, known, p["metric"], label, WEIGHT)
        best = 0
        for k, e in enumerate(errors):
            if e < errors[best]:
                best = k
            elif k - best >= p["early_stop"]:
                break
        if best + 1 < len(errors):
            model = fit_weighted(kind, given, label, rounds=best + 1)(data)
    return model, best + 1, errors


def score(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the value, or the probability of class 1."""
    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    return out.withColumnRenamed("prediction", name)


def label_of(p: Column, class_0: Any, class_1: Any) -> Column:
    """The likelier label; a tie is class 0."""
    return F.when(p > 0.5, F.lit(class_1)).otherwise(F.lit(class_0))


def lasso_cascade(train: DataFrame, test: DataFrame, given: dict[str, Any], strength: float = 0.1, label: str = "label") -> DataFrame:
    """Adds score: a lasso plus a booster of its residual. train may be cells()."""
    with held(compact(train, "regression", given, label)) as rows:
        linear = LinearRegression(labelCol=label, featuresCol="features", elasticNetParam=1.0, regParam=strength, predictionCol="_linear", weightCol=WEIGHT).fit(rows)
        # What a linear model leaves of a cell's two labels keeps their mean and deviation.
        boosted = fit_weighted("regression", given, "_rest")(linear.transform(rows).withColumn("_rest", F.col(label) - F.col("_linear")))
    return boosted.transform(linear.transform(test)).withColumn("score", F.col("_linear") + F.col("prediction")).drop("prediction")


def own_score(models: Sequence[Any], df: DataFrame, fold: str = "fold", name: str = "score") -> DataFrame:
    """Rows of folds 0, 1, ..., each scored by its fold's model, in one pass over df."""
    out = df.where(F.col(fold).isin(list(range(len(models)))))
    for k, m in enumerate(models):
        out = score(m, out, f"_o{k}")
    return out.withColumn(name, F.coalesce(*(F.when(F.col(fold) == k, F.col(f"_o{k}")) for k in range(len(models))))).drop(*(f"_o{k}" for k in range(len(models))))


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Any], k: int, fold: str = "fold", name: str = "score", test: DataFrame | None = None, most: int = SIDE_BY_SIDE, kind: str | None = None, label: str = "label"):
    """Every row scored by the model of the other folds; with `test`, also the test rows with the mean of all k models.

    The driver only loops, `most` fits side by side; each fit is a Spark job. With `kind`, fit gets cells() of df and is to
    use WEIGHT: fits then take as long as there are different features.
    """
    with held(cells(df, kind, label, [fold]) if kind else df) as data:
        models = side_by_side([lambda i=i: fit(data.where(F.col(fold) != i)) for i in range(k)], most)
    own = own_score(models, df, fold, name)
    return own if test is None else (own, mean_score(models, test, name))


def mean_score(models: Sequence[Any], df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the mean of several models' scores, in one pass over df."""
    for k, m in enumerate(models):
        df = score(m, df, f"_s{k}")
    columns = [f"_s{k}" for k in range(len(models))]
    return df.withColumn(name, sum(map(F.col, columns), F.lit(0.0)) / len(models)).drop(*columns)


def fit_targets(df: DataFrame, test: DataFrame, targets: Sequence[str], fit: Callable[[DataFrame], Any], k: int, key: str, fold: str = "fold", most: int = SIDE_BY_SIDE, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of several targets over the same folds, and the test scores in long form.

    fit takes a table whose label is `label`; fits run `most` side by side over a cached
    table: of all targets, or with `kind` the cells() of each target, and fit is to use WEIGHT.
    Returns df with score_{target} for each, and (target_id, target) of test.
    """
    told = test
    if kind:
        of = {}
        for t in targets:
            with held(cells(df.withColumn("label", F.col(t).cast("double")), kind, "label", [fold])) as data:
                of[t] = side_by_side([lambda i=i: fit(data.where(F.col(fold) != i)) for i in range(k)], most)  # noqa: B023
    else:
        with held(df) as data:
            jobs = [lambda t=t, i=i: fit(data.where(F.col(fold) != i).withColumn("label", F.col(t).cast("double"))) for t in targets for i in range(k)]
            models = side_by_side(jobs, most)
        of = {t: models[at * k : (at + 1) * k] for at, t in enumerate(targets)}
    own = df
    for t in targets:
        own = own_score(of[t], own, fold, f"score_{t}")
    for t in targets:
        told = mean_score(of[t], told, f"score_{t}")
    return own, long_targets(told, key, [f"score_{t}" for t in targets])


def importance(model, features: Sequence[str]) -> list[tuple[str, float, int]]:
    """(feature, gain, splits) of a booster."""
    import re

    splits = [0] * len(features)
    for at in re.findall(r"If \(feature (\d+)", model.toDebugString):
        splits[int(at)] += 1
    return [(f, float(model.featureImportances[k]), splits[k]) for k, f in enumerate(features)]


def forward_selection(df: DataFrame, fixed: Sequence[str], candidates: Sequence[str], fit: Callable[[DataFrame], Any], valid: Column, label: str = "label") -> list[tuple[str, float, bool]]:
    """(feature, rmse with it, kept): a candidate stays if it lowers the error on valid."""
    def error(features: Sequence[str]) -> float:
        with held(assembled(df, features)) as both:
            out = score(fit(both.where(~valid)), both.where(valid))
            return out.agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col(label), 2)))).first()[0]

    kept, best, out = list(fixed), error(fixed), []
    for c in candidates:
        e = error([*kept, c])
        out.append((c, e, e < best))
        if e < best:
            kept, best = [*kept, c], e
    return out


def cross_validated(df: DataFrame, estimator, grid: dict[str, Sequence[Any]], k: int, fold: str = "fold", label: str = "label", metric: str = "rmse"):
    """The best model over a grid of parameter names, by given folds. Metrics are rmse, mse and r2, mae, or auc for classes.

    Fits take cells() of the rows, `SIDE_BY_SIDE` at a time; mae, which needs every label, rows of weight 1. Rows that have
    WEIGHT are cells already. The area under the curve counts every distinct score.
    """
    build = ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(estimator.getParam(name), list(values))
    maps, trees = build.build(), estimator.hasParam("minInstancesPerNode")
    check = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0, weightCol=WEIGHT) if metric == "auc" else RegressionEvaluator(labelCol=label, metricName=metric, weightCol=WEIGHT)
    whole = metric == "mae" or (trees and estimator.getSubsamplingRate() < 1)

    def fit(rows: DataFrame, chosen: dict) -> Any:
        one = estimator.copy(chosen)
        return (weighted(one, rows, one.getMinInstancesPerNode()) if trees else one.setWeightCol(WEIGHT)).fit(rows)

    if WEIGHT in df.columns:
        if whole:
            raise ValueError("mae, and trees of a share of the rows, take rows and no cells")
        rows = df.select("features", fold, label, WEIGHT)
    else:
        rows = df.select("features", fold, label, F.lit(1.0).alias(WEIGHT)) if whole else cells(df, "binary" if metric == "auc" else "regression", label, [fold])
    with held(rows) as data:
        tried = side_by_side([lambda i=i, m=m: check.evaluate(fit(data.where(F.col(fold) != i), m).transform(data.where(F.col(fold) == i))) for m in maps for i in range(k)])
        of = [tried[at * k : (at + 1) * k] for at in range(len(maps))]
        means = [sum(e) / k for e in of]
        best = (max if check.isLargerBetter() else min)(range(len(maps)), key=means.__getitem__)
        found = CrossValidatorModel(fit(data, maps[best]), means, stdMetrics=[(sum((x - m) ** 2 for x in e) / k) ** 0.5 for e, m in zip(of, means, strict=True)])
    return CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=check, numFolds=k, foldCol=fold)._copyValues(found)


def long_targets(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """(target_id, target): a row for each id and target, the id being {key}_{place}."""
    cells = F.array(*(F.struct(F.concat_ws("_", F.col(key).cast("string"), F.lit(k)).alias("target_id"), F.col(t).alias("target")) for k, t in enumerate(targets)))
    return df.select(F.explode(cells).alias("x")).select("x.*")
