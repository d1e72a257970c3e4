"""Hand-made frames: nulls, ties, unseen levels, single rows, constants, and independence of partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import blend, encode, evaluate, folds, impute, merge, model, order, scalar, select, stats, windows
from tabloom.sources import files


@pytest.fixture(scope="module")
def cats(spark):
    train = [(k, a) for k, a in enumerate(["x", "y", "x", "z", "y", "x", "w", "z", None])]
    return spark.createDataFrame(train, "id long, a string"), spark.createDataFrame([(100, "x"), (101, "new"), (102, None)], "id long, a string")


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_encoders_on_ties_nulls_and_unseen_levels(cats):
    train, test = cats
    assert by(encode.fit_ordinal(train, "a"), "level", "code") == {"x": 1, "y": 2, "z": 3, "w": 4}
    assert by(encode.apply_codes(test, encode.fit_ordinal(train, "a"), "a", "c"), "id", "c") == {100: 1, 101: None, 102: None}
    assert by(encode.apply_codes(test, encode.fit_factors(train, test, "a"), "a", "c", -1), "id", "c") == {100: 2, 101: 0, 102: -1}
    with pytest.raises(ValueError):
        encode.fit_labels(train, "a", classes=2)
    assert set(by(encode.collapse_rare(train, "a", 2), "id", "a").values()) == {"x", "Other"}
    y = train.withColumn("y", F.col("id").cast("double"))
    got = by(encode.apply_target_mean(test, encode.fit_target_mean(y, "a", "y"), "a", "m"), "id", "m")
    assert got == {100: pytest.approx(7 / 3), 101: 4.0, 102: 4.0}


def test_words(spark):
    df = spark.createDataFrame([("Main Street",), ("Stone Road",), (None,), ("",), ("one",), ("a  b",)], "s string")
    words = [("Street", "st"), ("St", "short"), ("Road", "rd")]
    assert [r[0] for r in df.select(encode.keyword_class("s", words, "Street")).collect()] == ["st", "short", "Street", None, None, None]
    assert [r[0] for r in df.select(encode.token("s", 1)).collect()] == ["Street", "Road", None, None, None, "b"]


def test_interpolation_and_rolling_on_gaps(spark):
    rows = [("a", k, v) for k, v in enumerate([None, 2.0, None, None, 8.0, None])] + [("b", 0, None), ("b", 1, None), ("c", 0, 5.0)]
    df = spark.createDataFrame(rows, "site string, pos int, v double")
    got = {(r.site, r.pos): r.x for r in df.select("site", "pos", impute.interpolate("v", ["site"], ["pos"]).alias("x")).collect()}
    assert [got["a", k] for k in range(6)] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0] and got["b", 0] is None and got["c", 0] == 5.0
    roll = {(r.site, r.pos): r for r in df.select("site", "pos", *(c.alias(k) for k, c in windows.rolling("v", ["site"], ["pos"], 3).items())).collect()}
    assert roll["c", 0].v_std == 0 and roll["c", 0].v_skew == 0 and roll["b", 1].v_mean is None and roll["a", 4].v_mean == 8.0


def test_merge_pivot_and_its_errors(spark):
    dim = spark.createDataFrame([(3, 1, "p"), (1, 1, "q"), (2, 5, "r")], "k1 int, k2 int, x string")
    fact = spark.createDataFrame([(0, 1, 1), (1, 2, 5), (2, 3, 1), (3, 9, 9)], "id int, k1 int, k2 int")
    assert by(merge.merge_pivot(fact, dim, ["k1", "k2"], "d"), "id", "@M_d") == {0: 0, 1: 1, 2: 2, 3: 3}
    with pytest.raises(ValueError):
        merge.merge_pivot(fact, dim.union(dim), ["k1", "k2"], "d")
    with pytest.raises(ValueError):
        merge.merge_pivot(fact.where("id = 3"), dim, ["k1", "k2"], "d")


def test_merged_histogram_equals_the_join(spark):
    fact = spark.range(500).select((F.col("id") * 7 % 13).alias("k"), (F.col("id") % 10).cast("double").alias("y"))
    dim = spark.range(11).select(F.col("id").alias("k"), F.when(F.col("id") != 4, F.col("id") * 1.5).alias("f"))
    got = {r.bin: (r.n, r.sum_y, r.sum_y2) for r in merge.merged_histogram(fact, dim, ["k"], "y", {"f": [3.0, 9.0]}, "d").collect()}
    x = F.col("f")
    joined = fact.join(dim, "k", "left").groupBy(F.when(x.isNull(), -1).otherwise((x >= 3).cast("int") + (x >= 9).cast("int")).alias("bin"))
    assert got == {r.bin: (r.n, r.s, r.q) for r in joined.agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("q")).collect()}
    assert merge.weighted_edges(fact, dim, ["k"], "f", 4) == sorted(merge.weighted_edges(fact, dim, ["k"], "f", 4))


def test_narrow_types_have_strict_bounds(spark):
    df = spark.createDataFrame([(126, 127, -128, 32766, 1 << 40), (0, 0, 0, 0, 0)], "a int, b int, c int, d int, e long").withColumn("f", F.lit(0.5))
    found = select.narrow_types(df, df.columns)
    assert by(found, "column", "type") == {"a": "tinyint", "b": "smallint", "c": "smallint", "d": "smallint", "e": "bigint", "f": "float"}
    assert dict(select.apply_types(df, found).dtypes)["a"] == "tinyint"
    odd = spark.createDataFrame([("y", 1e300, True, 1.5), ("x", 0.0, False, None), (None, None, None, None)], "s string, d double, b boolean, n double").withColumn("t", F.lit("2020-01-01").cast("timestamp_ntz"))
    found = select.narrow_types(odd, odd.columns)
    assert by(found, "column", "type") == {"s": "category", "d": "double", "b": "boolean", "n": "float", "t": "timestamp_ntz"}
    out = select.apply_types(odd, found)
    assert sorted(map(str, ((r.s, r.d, r.n) for r in out.collect()))) == sorted(map(str, [(1, 1e300, 1.5), (0, 0.0, None), (-1, None, None)])) and out.columns == odd.columns


def test_odd_numbers_and_constants(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, float("inf")), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(scalar.fill_odd("b", 0.0)).collect()] == [0.0, 0.0, 2.0]
    assert by(select.constant_columns(df.select("a"), ["a"]), "column", "is_constant") == {"a": True}
    assert by(stats.null_counts(df), "column", "nulls") == {"a": 1, "b": 0}


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 9.999, 10, 10.001, 300)], "x double")
    assert [r[0] for r in df.select(stats.equal_width_bin(F.col("x"), F.lit(0.0), F.lit(300.0), 30)).collect()] == [1, 1, 1, 1, 2, 30]
    edges = [1.0, 10.0, 300.0]
    assert [r[0] for r in df.select(stats.bin_of(F.col("x"), edges)).collect()] == [0, 1, 1, 2, 2, 3]


def test_auc_on_ties_and_separation(spark):
    rows = [(0, 0, 0.1), (1, 0, 0.5), (2, 1, 0.5), (3, 1, 0.9)]
    df = spark.createDataFrame(rows, "id int, y int, s double")
    assert evaluate.auc(df, "s", "y").first().auc == pytest.approx(0.875)
    assert evaluate.auc(df.withColumn("s", F.lit(1.0)), "s", "y").first().auc == 0.5
    assert evaluate.auc(df.where("y = 1"), "s", "y").first().auc is None
    assert evaluate.auc_by_position(df.where("id <> 1"), "s", "y", "id").first().auc == 1.0
    p = spark.createDataFrame([(0.5,), (0.51,)], "p double").select(model.label_of(F.col("p"), "a", "b")).collect()
    assert [r[0] for r in p] == ["a", "b"]


@pytest.mark.parametrize("parts", [1, 7])
def test_folds_do_not_depend_on_partitions(spark, parts):
    df = spark.range(101).select("id", (F.col("id") % 3).alias("c")).repartition(parts)
    numbered = by(folds.global_row_number(df, F.col("c"), "id"), "id", "row_no")
    assert [k for k, _ in sorted(numbered.items(), key=lambda x: x[1])] == sorted(range(101), key=lambda k: (k % 3, k))
    sizes = [r["count"] for r in folds.kfold_stratified(df, "id", "c", 5).groupBy("c", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert sum(hash((r.id, r.fold)) for r in folds.kfold_shuffled(df, "id", 5, 3).collect()) == sum(hash((r.id, r.fold)) for r in folds.kfold_shuffled(df.coalesce(1), "id", 5, 3).collect())


def test_blends_align_by_id(spark):
    one, two = spark.createDataFrame([(1, 2.0), (2, 8.0)], "id int, p double"), spark.createDataFrame([(2, 2.0), (1, 2.0)], "id int, p double")
    wide, names = blend.aligned([one, two], "id", "p")
    assert by(wide.select("id", blend.log_mean(names).alias("p")), "id", "p") == {1: pytest.approx(2.0), 2: pytest.approx(4.0)}
    with pytest.raises(Exception, match="same ids"):
        blend.aligned([one, two.where("id = 1")], "id", "p")[0].collect()
    big = spark.createDataFrame([(1000.0, 1000.0)], "a double, b double").select(blend.log_sum_exp(["a", "b"])).first()[0]
    assert big == pytest.approx(1000 + math.log(2))


def test_quantiles_become_normal(spark):
    df = spark.range(2001).select(F.col("id").cast("double").alias("x"))
    out = np.sort([r.x for r in scalar.quantile_normal(df, scalar.fit_quantiles(df, ["x"])).collect()])
    assert abs(out.mean()) < 1e-6 and abs(out[1000]) < 1e-9 and 0.9 < out.std() < 1.1
    p = [1e-7, 0.001, 0.3, 0.5, 0.7, 0.975, 0.999, 1 - 1e-7]
    found = spark.createDataFrame([(x,) for x in p], "p double").select(scalar.normal_inverse(F.col("p")).alias("z"), "p").collect()
    assert [0.5 * math.erfc(-r.z / math.sqrt(2)) for r in found] == pytest.approx([r.p for r in found], rel=1e-7)
    rows = [(float(x),) for x in (-5, 1, 1, 2, 3, 9, 1.5, 20)]
    q, level = np.array([1.0, 1.0, 1.0, 2.0, 9.0]), np.linspace(0, 1, 5)
    want = [(np.interp(x, q, level) + 1 - np.interp(-x, -q[::-1], level)) / 2 for (x,) in rows]
    got = [r.l for r in spark.createDataFrame(rows, "x double").select(scalar.level_of(F.col("x"), q.tolist()).alias("l")).collect()]
    assert got == pytest.approx(want)
    flat = spark.range(300).select("id", (F.col("id") % 3).cast("double").alias("x"))
    noised = scalar.fit_quantiles(flat, ["x"], 100, noised=1e-3, key="id")
    assert len(set(scalar.fit_quantiles(flat, ["x"], 100)["x"])) <= 5 < 90 < len(set(noised["x"]))
    assert scalar.fit_quantiles(flat.repartition(5), ["x"], 100, noised=1e-3, key="id")["x"] == pytest.approx(noised["x"], abs=1e-12)
    with pytest.raises(ValueError):
        scalar.fit_quantiles(flat, ["x"], noised=1e-3)


def test_parameters_and_aliases():
    p = model.parameters({"n_estimators": 9, "num_trees": 7.0, "num_boost_round": "3", "subsample": 0.5, "bagging_fraction": 0.7, "early_stopping": 4, "metric": "mean_squared_error", "seed": 3, "eta": 1})
    assert p["num_trees"] == 3 and p["subsample"] == 0.5 and p["early_stop"] == 4 and p["metric"] == "rmse" and p["learning_rate"] == 0.1
    assert model.parameters({})["metric"] == "mse" and model.parameters({"metric": "l1"})["metric"] == "mae" and model.parameters({"metric": "auc"})["metric"] == "auc"


GIVEN = {"n_estimators": 8, "early_stop": 2, "learning_rate": 0.5, "min_data_in_leaf": 1, "max_depth": 3}


@pytest.fixture(scope="module")
def data(spark):
    rows = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.hash("id") % 7).cast("double").alias("b"), (F.hash("id", F.lit(1)) % 5).cast("double").alias("c"))
    rows = rows.withColumn("label", F.col("a") * 2 + F.col("b")).withColumn("flag", (F.col("label") + F.col("c") > 20).cast("double"))
    return model.assembled(rows.withColumn("fold", F.pmod(F.hash("id", F.lit(3)), F.lit(3)).cast("int")), ["a", "b"])


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("score") - F.col("label")) ** 2))).first()[0]


@pytest.mark.parametrize("metric", ["mse", "rmse", "mae"])
def test_early_stop_keeps_the_best_round(data, metric):
    train, valid = data.where("fold <> 0"), data.where("fold = 0")
    fitted, best, errors = model.fit_early("regression", GIVEN | {"metric": metric}, train, valid)
    assert len(fitted.trees) == best and errors[best - 1] == min(errors[:best])
    own = model.score(fitted, valid)
    gap = F.abs(F.col("score") - F.col("label"))
    want = own.agg(F.avg(gap) if metric == "mae" else F.avg(gap * gap)).first()[0]
    assert errors[best - 1] == pytest.approx(want**0.5 if metric == "rmse" else want)
    assert rmse(own) < valid.agg(F.stddev_pop("label")).first()[0]


@pytest.mark.parametrize("metric", ["auc", "logloss"])
def test_early_stop_of_classes(data, metric):
    both = data.withColumn("label", F.col("flag"))
    fitted, best, errors = model.fit_early("binary", GIVEN | {"metric": metric}, both.where("fold <> 0"), both.where("fold = 0"))
    own = model.score(fitted, both.where("fold = 0"))
    assert errors[best - 1] == min(errors[:best]) and 0.8 < evaluate.auc(own, "score", "label").first().auc
    if metric == "auc":
        assert -errors[best - 1] == pytest.approx(evaluate.auc(own, "score", "label").first().auc)
    else:
        assert errors[best - 1] == pytest.approx(own.agg(F.avg(-F.when(F.col("label") == 1, F.log("score")).otherwise(F.log1p(-F.col("score"))))).first()[0])
    with pytest.raises(ValueError):
        model.round_errors(model.booster("regression", GIVEN | {"num_trees": 1}).fit(data), data, "auc")


def test_models_beat_the_mean_and_repeat(data):
    guess = data.agg(F.stddev_pop("label")).first()[0]
    fit = model.booster("regression", GIVEN).fit
    own, told = model.out_of_fold(data, fit, 3, test=data.where("id < 30").drop("label"))
    assert own.count() == 400 and rmse(own) < guess / 2 and told.count() == 30
    again = {r.id: r.score for r in model.out_of_fold(data, fit, 3).collect()}
    assert all(again[r.id] == r.score for r in own.collect())
    one = {r.id: r.score for r in model.score(fit(data.where("fold <> 0")), data.where("fold = 0")).collect()}
    assert all(again[k] == v for k, v in one.items())
    cascade = model.lasso_cascade(data.where("fold <> 0"), data.where("fold = 0"), GIVEN)
    assert rmse(cascade) < guess / 2
    mean = model.mean_score([fit(data.where("fold <> 0")), fit(data.where("fold <> 1"))], data)
    assert rmse(mean) < guess / 2 and "_s0" not in mean.columns


def test_importance_selection_grid_and_targets(data):
    fit = model.booster("regression", GIVEN).fit
    gains = model.importance(fit(data), ["a", "b"])
    assert gains[0][1] > gains[1][1] > 0 and gains[0][2] > 0 and sum(g for _, g, _ in gains) == pytest.approx(1)
    chosen = model.forward_selection(data.drop("features"), ["a"], ["b", "c"], fit, F.col("fold") == 0)
    assert [(f, kept) for f, _, kept in chosen][0] == ("b", True) and chosen[0][1] < chosen[1][1] + 1e-9
    found = model.cross_validated(data.withColumn("label", F.col("flag")), model.booster("binary", GIVEN), {"maxDepth": [1, 3]}, 3, metric="auc")
    assert len(found.avgMetrics) == 2 and min(found.avgMetrics) > 0.8
    two = data.withColumns({"t0": F.col("label"), "t1": F.col("label") * 3}).drop("label")
    own, told = model.fit_targets(two.where("id >= 40"), two.where("id < 40"), ["t0", "t1"], fit, 3, "id")
    assert {"score_t0", "score_t1"} <= set(own.columns) and told.count() == 80
    by_id = by(told, "target_id", "target")
    assert by_id["3_1"] == pytest.approx(3 * by_id["3_0"], rel=0.15)  # splits that tie may fall apart


def test_ranges_give_whole_orders_and_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(int(k), None if k % 11 == 0 else int(x), float(y)) for k, x, y in zip(range(900), rng.integers(0, 3, 900), np.round(rng.normal(0, 2, 900), 1), strict=True)]
    df = spark.createDataFrame(rows, "id long, g int, y double").repartition(7)
    got = [r.id for r in order.global_row_number(df, "g", -F.col("id")).orderBy("row_no").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[0]))]
    sizes = [r["count"] for r in order.in_ranges(df, ["g", "id"]).groupBy("_range").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 200  # a first column of three values is cut by the second
    levels = [0.0, 0.1, 0.5, 0.99, 1.0]
    for r in order.quantiles_by(df, ["g"], "y", levels).collect():
        assert np.allclose(r.q, np.quantile([y for _, g, y in rows if g == r.g], levels))
    assert np.allclose(order.quantiles(df, ["y", "id"], levels)["id"], np.quantile(range(900), levels))
    near = order.quantiles(df, ["id"], [0.5], accuracy=1000)["id"][0]
    assert abs(near - 450) < 5 and order.quantiles(df.where("false"), ["y"], levels) == {}
    stats_ = {r.g: (r.s_mean, r.s_median) for r in merge.fit_group_stats(df, ["g"], "y", "s").collect()}
    assert all(np.allclose(stats_[g], (np.mean(v), np.median(v))) for g in (None, 0, 1, 2) for v in [[y for _, x, y in rows if x == g]])


@pytest.mark.parametrize("codec", ["gzip", "bzip2"])
def test_compressed_csv_and_many_files(spark, tmp_path, codec):
    df = spark.range(50).select("id", (F.col("id") / 7).alias("x"))
    for k in range(2):
        files.write_csv(df.where(F.col("id") % 2 == k), str(tmp_path / f"{codec}{k}"), codec)
    back = files.read_csv(spark, [str(tmp_path / f"{codec}{k}") for k in range(2)], df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_parts_cache_submission_and_splits(spark, tmp_path):
    for k in range(2):
        part = spark.range(k * 5, k * 5 + 5)
        files.write_csv(part.select("id", (F.col("id") * 2).alias("f")), str(tmp_path / f"x{k}"))
        files.write_csv(part.select("id", (F.col("id") * 3).alias("y")), str(tmp_path / f"y{k}"))
    out = files.load_parts(spark, [str(tmp_path / f"x{k}") for k in range(2)], [str(tmp_path / f"y{k}") for k in range(2)], "id long, f long", "id long, y long", "id")
    assert sorted((r.part, r.id, r.f, r.y) for r in out.collect()) == [(k // 5, k, 2 * k, 3 * k) for k in range(10)]
    made = []
    for _ in range(2):
        cached = files.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3))
    assert len(made) == 1 and cached.count() == 3
    files.write_submission(spark.createDataFrame([(1, 0.123456)], "k long, p double"), str(tmp_path / "sub"), "k", "p")
    assert spark.read.option("header", True).csv(str(tmp_path / "sub")).collect() == [("1", "0.1235")]
    files.write_splits(spark.range(4).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test")), str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits/split=test")).count() == 1
