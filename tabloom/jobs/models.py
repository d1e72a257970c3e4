"""Queries of the models. All fit and score whole tables; they have no SQL form."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabloom.functions.keys import bucket
from tabloom.jobs.registry import query, read
from tabloom.operators import encode, model, scalar

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "month"]
#: Small fits, so that all queries of the models can run side by side; the defaults are those of model.PARAMETERS.
GIVEN = {"num_boost_round": 5, "learning_rate": 0.3, "max_depth": 3, "max_bin": 32, "early_stop": 2, "metric": "rmse"}


def items(spark, d, label="price"):
    """lineitem by a key of all its columns, with folds."""
    df = read(spark, d, "lineitem")
    key = F.xxhash64(*df.columns)
    y = F.log1p("l_extendedprice") if label == "price" else (F.col("l_returnflag") == "R").cast("double")
    df = df.select(key.alias("id"), "l_quantity", "l_discount", "l_tax", "l_linenumber", F.month("l_shipdate").alias("month"), y.alias("label"))
    return model.assembled(df.withColumn("fold", (bucket("id") % 3).cast("int")), FEATURES)


def summed(df, kind, by=("fold",)):
    """Cells of items(), whose features are made after the sums and not row by row."""
    return model.assembled(model.cells(df, kind, by=by, of=FEATURES), FEATURES)


@query("gbt_regression")
def gbt_regression(spark, d):
    df = items(spark, d)
    with model.held(summed(df.where("fold > 0"), "regression")) as data:
        fitted, _, _ = model.fit_early("regression", GIVEN, data.where("fold = 1"), data.where("fold = 2"))
    return model.score(fitted, df.where("fold = 0")).select("id", "label", "score")


@query("gbt_binary")
def gbt_binary(spark, d):
    df = items(spark, d, "flag")
    with model.held(summed(df.where("fold > 0"), "binary")) as data:
        fitted, _, _ = model.fit_early("binary", GIVEN | {"metric": "auc"}, data.where("fold = 1"), data.where("fold = 2"))
    return model.score(fitted, df.where("fold = 0")).select("id", "label", "score", model.label_of(F.col("score"), "other", "R").alias("predicted"))


@query("early_stopping")
def early_stopping(spark, d):
    with model.held(summed(items(spark, d), "regression")) as data:
        _, best, errors = model.fit_early("regression", GIVEN, data.where("fold <> 0"), data.where("fold = 0"))
    return spark.createDataFrame([(k + 1, float(e), k + 1 == best) for k, e in enumerate(errors)], "round int, error double, best boolean")


@query("lasso_cascade")
def lasso_cascade(spark, d):
    df = items(spark, d)
    return model.lasso_cascade(summed(df.where("fold <> 0"), "regression", by=()), df.where("fold = 0"), GIVEN, 0.01).select("id", "label", "score")


@query("oof_predictions")
def oof_predictions(spark, d):
    df = items(spark, d)
    return model.out_of_fold(df, model.fit_weighted("regression", GIVEN), 3, kind="regression").select("id", "fold", "label", "score")


@query("feature_importance")
def feature_importance(spark, d):
    df = items(spark, d)
    with model.held(model.cells(df, "regression", by=["fold"])) as data:
        fits = model.side_by_side([lambda i=i: model.fit_weighted("regression", GIVEN)(data.where(F.col("fold") != i)) for i in range(3)])
    rows = [(i, *r) for i, fitted in enumerate(fits) for r in model.importance(fitted, FEATURES)]
    return spark.createDataFrame(rows, "fold int, feature string, gain double, splits int")


@query("forward_selection")
def forward_selection(spark, d):
    df = items(spark, d).drop("features")
    fit = LinearRegression(labelCol="label", featuresCol="features", regParam=0.001).fit
    return spark.createDataFrame(model.forward_selection(df, ["l_tax"], ["l_quantity", "l_discount", "month"], fit, F.col("fold") == 0), "feature string, rmse double, kept boolean")


@query("grid_search")
def grid_search(spark, d):
    df = summed(items(spark, d), "regression")
    found = model.cross_validated(df, model.booster("regression", GIVEN), {"maxDepth": [2, 3], "stepSize": [0.1, 0.3]}, 3)
    maps = [{p.name: v for p, v in m.items()} for m in found.getEstimatorParamMaps()]
    return spark.createDataFrame([(m["maxDepth"], m["stepSize"], float(e)) for m, e in zip(maps, found.avgMetrics, strict=True)], "depth int, rate double, rmse double")


@query("linear_cv")
def linear_cv(spark, d):
    raw = items(spark, d).drop("features")
    with model.held(model.cells(raw, "regression", by=["fold"], of=FEATURES)) as data:
        fitted = scalar.fit_robust(data.where("fold <> 0"), FEATURES, weight=model.WEIGHT)
        scaled = lambda df: model.assembled(scalar.apply_scale(df, fitted, FEATURES), FEATURES)
        found = model.cross_validated(scaled(data), LinearRegression(labelCol="label", featuresCol="features"), {"regParam": [0.001, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}, 3)
    return found.transform(scaled(raw)).select("id", "label", F.col("prediction").alias("score"))


@query("grid_search_auc")
def grid_search_auc(spark, d):
    found = model.cross_validated(summed(items(spark, d, "flag"), "binary"), model.booster("binary", GIVEN), {"maxDepth": [2, 3]}, 3, metric="auc")
    return spark.createDataFrame([(m[found.getEstimator().getParam("maxDepth")], float(e)) for m, e in zip(found.getEstimatorParamMaps(), found.avgMetrics, strict=True)], "depth int, auc double")


@query("oof_test_mean")
def oof_test_mean(spark, d):
    df = items(spark, d)
    own, told = model.out_of_fold(df.where("month <> 12"), model.fit_weighted("regression", GIVEN), 3, test=df.where("month = 12"), kind="regression")
    return own.unionByName(told).select("id", "month", "label", "score")


@query("multi_target_fit")
def multi_target_fit(spark, d):
    df = items(spark, d).withColumns({"t0": F.col("label"), "t1": F.col("l_quantity")}).drop("label")
    fit = LinearRegression(labelCol="label", featuresCol="features", regParam=0.001).fit
    own, told = model.fit_targets(df.where("month <> 12"), df.where("month = 12"), ["t0", "t1"], fit, 3, "id")
    return told.unionByName(model.long_targets(own, "id", ["score_t0", "score_t1"]))


@query("ensemble_models")
def ensemble_models(spark, d):
    df = items(spark, d)
    with model.held(model.cells(df.where("fold <> 0"), "regression")) as train:
        models = [model.fit_weighted("regression", GIVEN)(train), LinearRegression(labelCol="label", featuresCol="features", regParam=0.001, weightCol=model.WEIGHT).fit(train)]
    return model.mean_score(models, df.where("fold = 0")).select("id", "label", "score")


@query("stack_oof")
def stack_oof(spark, d):
    linear = LinearRegression(labelCol="label", featuresCol="features", regParam=0.001, weightCol=model.WEIGHT)
    boosted = model.fit_weighted("regression", GIVEN)
    both = model.out_of_fold(model.out_of_fold(items(spark, d), linear.fit, 3, name="s1", kind="regression"), boosted, 3, name="s2", kind="regression")
    meta = model.assembled(both.drop("features"), [*FEATURES, "s1", "s2"])
    with model.held(model.cells(meta.where("fold <> 0"), "regression")) as train:
        fitted = boosted(train)
    return model.score(fitted, meta.where("fold = 0")).select("id", "label", "score")


@query("gbt_categorical")
def gbt_categorical(spark, d):
    """(given, n, rmse): held-out errors for a target that sets of brands decide, with brands as levels, as codes, and by the mean."""
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_size", (F.log1p("p_retailprice") + 4 * (bucket("p_brand") % 2) + F.col("p_size") * 0.02).alias("label"))
    codes = encode.fit_labels(part, "p_brand")
    part = encode.apply_codes(part, codes, "p_brand", "brand_code").withColumn("fold", (bucket("p_partkey") % 4).cast("int"))
    train, test = part.where("fold > 1"), part.where("fold = 0")
    given = GIVEN | {"max_depth": 2, "max_bin": 64}
    levels = model.fit_model("regression", given, train, ["p_brand", "p_size"], valid=part.where("fold = 1"), categorical=["p_brand"], discrete=["p_size"])
    plain = model.fit_model("regression", given, train, ["brand_code", "p_size"], valid=part.where("fold = 1"))
    scored = plain.score(levels.score(test, "levels"), "codes").crossJoin(F.broadcast(train.agg(F.avg("label").alias("mean"))))
    error = lambda c: F.struct(F.lit(c).alias("given"), F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col(c) - F.col("label"), 2))).alias("rmse"))
    return scored.agg(F.array(*map(error, ("levels", "codes", "mean"))).alias("e")).select(F.inline("e"))
