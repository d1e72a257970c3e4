"""Hot entities, hot keys, ranges and wide tables: equal results by the plain way, and no task with more than its share."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabloom.jobs import readings
from tabloom.jobs.registry import ORACLE_SQL, QUERIES
from tabloom.operators import encode, evaluate, impute, merge, model, order, scalar, skew, stats, windows
from tabloom.sources import files

DATA = Path("/root/testdata/sf0.001")


def same(one, two):
    return sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, map(tuple, two.collect())))


@pytest.fixture(scope="module")
def series(spark):
    """A third of all rows are one user's, with gaps of up to 400 rows and a null user."""
    k = F.col("id")
    user = F.when(k % 3 == 0, 7).when(k % 31 == 1, None).otherwise(k % 40)
    value = F.when((k % 5 != 0) & ~(k.between(600, 1800) & (k % 3 == 0)), (k * 7919 % 1000) / 8)
    return spark.range(3000).select("id", user.cast("long").alias("user"), (k * 31 % 3001).alias("ts"), value.alias("v")).repartition(6).cache()


def test_rolling_in_chunks(spark, series):
    plain = series.select("*", *(c.alias(f"{n}_{size}") for size in (3, 18) for n, c in windows.rolling("v", ["user"], ["ts"], size).items()))
    cut = windows.add_rolling(series, "v", ["user"], ["ts"], [3, 18], rows=100)
    assert cut.columns == plain.columns
    rounded = lambda df: df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))
    assert same(rounded(cut), rounded(plain))
    sizes = [r["count"] for r in order.chunked(series, ["user"], ["ts"], 100).groupBy("_chunk").count().collect()]
    assert len(sizes) == 30 and set(sizes) == {100}


def test_interpolation_over_chunk_borders(spark, series):
    plain = series.withColumn("w", impute.interpolate("v", ["user"], ["ts"]))
    for rows in (50, 170, 10_000):
        cut = impute.add_interpolated(series, "v", ["user"], ["ts"], "w", rows)
        assert cut.columns == plain.columns
        assert same(cut.withColumn("w", F.round("w", 6)), plain.withColumn("w", F.round("w", 6)))


def test_five_thousand_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "RANGE_ROWS", 4)
    monkeypatch.setattr(order, "FANOUT", 80)
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("x"), (F.col("id") % 5).alias("w")).repartition(4)
    ranged = order.in_ranges(df, ["x"]).groupBy("_range").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_range").collect()
    assert len(ranged) > 3000 and max(r.n for r in ranged) < 40
    assert all(a.hi < b.lo for a, b in zip(ranged, ranged[1:], strict=False))
    xs = sorted(r.x for r in df.collect())
    assert [r.x for r in order.global_row_number(df, "x").orderBy("row_no").collect()] == xs
    total = 0
    for r in order.running_sums(df, ["x"], {"below": "w"}).orderBy("x").collect():
        assert r.below == total
        total += r.w


def test_weighted_quantiles(spark):
    rng = random.Random(2)
    cells = {(g, v): (rng.randrange(4), rng.randrange(4)) for g in "ab" for v in rng.sample(range(100), 30)}
    cells |= {("c", 5): (1, 0), ("c", 9): (1, 0)}
    df = spark.createDataFrame([(g, float(v), *w) for (g, v), w in cells.items()], "g string, v double, a int, b int")
    levels = [0.5, 0.1, 0.9]
    for r in order.weighted_quantiles_by(df, ["g"], "v", ["a", "b"], levels).collect():
        for k in range(2):
            x = [v for (g, v), w in cells.items() if g == r.g for _ in range(w[k])]
            assert (r.q[k] is None) if not x else np.allclose(r.q[k], np.quantile(x, levels))


def test_a_level_with_half_of_all_rows_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 20)
    monkeypatch.setattr(skew, "SHARES", 200)
    k = F.col("id")
    fact = spark.range(8000).select("id", F.when(k % 2 == 0, "hot").when(k % 4 == 1, None).otherwise((k % 200).cast("string")).alias("a"))
    dim = fact.where("a is not null").groupBy("a").agg(F.count("*").alias("n"))
    met = merge.left_join(fact, dim, ["a"])
    assert met.columns == ["id", "a", "n"] and same(met, fact.join(dim, "a", "left").select("id", "a", "n"))
    shuffled = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, value in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false"), ("shuffle.partitions", "8")):
            spark.conf.set(f"spark.sql.{name}", value)
        tasks = [r["count"] for r in merge.left_join(fact, dim, ["a"]).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    finally:
        for name, value in zip(("autoBroadcastJoinThreshold", "adaptive.enabled", "shuffle.partitions"), shuffled, strict=True):
            spark.conf.set(f"spark.sql.{name}", value)
    assert len(tasks) == 8 and max(tasks) < 2 * np.median(tasks)


def test_ten_columns_without_moving_the_facts(spark, monkeypatch):
    names = [f"c{j}" for j in range(10)]
    df = spark.range(500).select("id", *((F.col("id") * (j + 3) % (5 + 7 * j)).cast("string").alias(f"c{j}") for j in range(9)), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("c9"))
    fitted = encode.fit_frequency(df, df.limit(0), names)
    few = encode.apply_frequency(df, fitted, names)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 10
    monkeypatch.setattr(encode, "FEW_LEVELS", 20)
    many = encode.apply_frequency(df, fitted, names, key="id")
    assert many.columns == few.columns == [*df.columns, *(f"{c}_freq" for c in names)]
    assert same(many, few)
    monkeypatch.setattr(encode, "ONE_BY_ONE", 100)
    assert same(encode.apply_frequency(df, fitted, names), few)


def test_dense_counters_of_many_features(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 60)), 2)
    rows = [(float(k % 7) if k % 13 else None, *(None if (k + j) % 17 == 0 else float(v) for j, v in enumerate(r))) for k, r in enumerate(x)]
    columns = [f"f{j}" for j in range(60)]
    df = spark.createDataFrame(rows, "y double, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    edges = {c: sorted(set(np.quantile(x[:, j], [0.2, 0.5, 0.8]).tolist())) for j, c in enumerate(columns)}
    got = {(r.feature, r.bin): (r.n, round(r.sum_y, 6), round(r.sum_y2, 6)) for r in stats.bin_target_stats(df, edges, "y").collect()}
    want = {}
    for r in rows:
        for j, c in enumerate(columns):
            if r[0] is not None:
                at = (c, -1 if r[j + 1] is None else sum(e <= r[j + 1] for e in edges[c]))
                n, s, q = want.get(at, (0, 0.0, 0.0))
                want[at] = (n + 1, s + r[0], q + r[0] ** 2)
    assert got == want
    assert "Generate" not in stats.bin_target_stats(df, edges, "y")._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_values_have_bins_of_their_own(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 5 < 2, 3.0).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") / 100).alias("x"))
    edges = stats.fit_bins(df, ["x"], 8, mode="frequency")["x"]
    binned = {r.bin: (r.n, r.v) for r in df.groupBy(stats.bin_of(F.col("x"), edges).alias("bin")).agg(F.count("*").alias("n"), F.count_distinct("x").alias("v")).collect()}
    (own,) = [b for b, (n, v) in binned.items() if v == 1 and n >= 400]
    assert binned[own][0] == 400 and -1 in binned and len(binned) <= 10
    with pytest.raises(ValueError):
        stats.fit_bins(df, ["x"], mode="none")


def test_group_encoders_of_several_keys(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") % 3).cast("string").alias("b"), F.when(F.col("id") % 6 == 0, -1.0).otherwise(F.col("id").cast("double")).alias("v"))
    one = stats.group_encode(stats.group_encode(df, "a", ["v"]), "b", ["v"])
    assert same(stats.group_encode_all(df, ["a", "b"], ["v"]).select(one.columns), one)
    counts = {r.b: r.b_a_ct for r in stats.nunique_encode(df, "b", "a").collect()}
    assert counts == {None: None, "0": 7, "1": 7, "2": 7}


def categories(spark, rows, levels, seed):
    rng = random.Random(seed)
    made = [(k, rng.choice(levels), rng.choice([1, 2, 3]), rng.choice([0.1, 0.2, -0.1]), rng.random() < 0.5) for k in range(rows)]
    return spark.createDataFrame(made, "id long, A string, B int, C double, D boolean")


def test_boosters_split_by_sets_of_levels(spark):
    train = categories(spark, 300, "abcdfghijkl", 1).withColumn("label", F.when(F.col("A").isin(*"adfilk"), 3.0).otherwise(1.0) + F.col("B") * 0.1)
    test = categories(spark, 60, "abe", 2).withColumn("label", F.when(F.col("A") == "a", 3.0).otherwise(1.0) + F.col("B") * 0.1)
    given, names = {"num_boost_round": 4, "max_depth": 2, "min_data_in_leaf": 2, "learning_rate": 0.5, "max_bin": 32}, ["A", "B", "C", "D"]
    by_name = model.fit_model("regression", given, train, names, categorical=["A"], discrete=["B"])
    by_place = model.fit_model("regression", given, train, names, categorical=[0], discrete=[1])
    scores = {r.id: (r.A, r.score, r.label) for r in by_name.score(test).collect()}
    assert {r.id: r.score for r in by_place.score(test).collect()} == {k: s for k, (_, s, _) in scores.items()}
    assert all(s is not None for _, s, _ in scores.values()) and any(a == "e" for a, _, _ in scores.values())  # an unseen level scores
    codes = encode.fit_labels(train, "A")
    coded = model.fit_model("regression", given, encode.apply_codes(train, codes, "A", "code"), ["code", "B", "C", "D"])
    rmse = lambda rows: float(np.sqrt(np.mean([(s - y) ** 2 for s, y in rows])))
    numeric = [(r.score, r.label) for r in coded.score(encode.apply_codes(test, codes, "A", "code", -1)).where("A != 'e'").collect()]
    assert rmse([(s, y) for a, s, y in scores.values() if a != "e"]) < 0.7 * rmse(numeric)
    all_four = model.fit_model("binary", given, train.withColumn("label", (F.col("label") > 2).cast("double")), names, valid=train.withColumn("label", (F.col("label") > 2).cast("double")), categorical=names)
    assert all(0 <= r.score <= 1 for r in all_four.score(test).collect())
    for bad in ({"categorical": ["A"], "discrete": ["A"]}, {"categorical": ["x"]}):
        with pytest.raises(ValueError):
            model.fit_features(train, names, **bad)
    with pytest.raises(ValueError, match="A has 11 levels"):
        model.fit_model("regression", given | {"max_bin": 11}, train, names, categorical=["A"])


def test_fits_side_by_side_give_equal_scores(spark):
    df = model.assembled(spark.range(200).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") % 17).alias("x"), (F.col("id") * 2.0).alias("label"), (F.col("id") % 17 * 3.0).alias("t")), ["x"])
    fit = LinearRegression(labelCol="label", featuresCol="features").fit
    one, four = (model.out_of_fold(df, fit, 3, most=n).select("id", F.round("score", 9)) for n in (1, 4))
    assert same(one, four)
    own, told = model.fit_targets(df.drop("label"), df.drop("label"), ["t", "id"], fit, 3, "id")
    assert own.count() == 200 and told.count() == 400 and "label" not in own.columns
    with pytest.raises(ZeroDivisionError):
        model.side_by_side([lambda: 1 / 0, lambda: 2])


def test_parts_are_aligned_by_place(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for part in range(2):
        (tmp_path / f"x_{part}.csv").write_text("f,g\n" + "".join(f"{part * 1000 + k},{'' if k % 7 == 0 else k}\n" for k in range(300)))
        (tmp_path / f"y_{part}.csv").write_text("".join("\n" if k % 11 == 0 else f"{part * 1000 + k}\n" for k in range(300)))
    paths = {k: [str(tmp_path / f"{k}_{part}.csv") for part in range(2)] for k in "xy"}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        assert spark.read.text(paths["x"]).rdd.getNumPartitions() > 4
        out = files.load_aligned(spark, paths["x"], paths["y"], "f int, g int", "y int", True, False).collect()
        assert len(out) == 600 and all(r.f == r.part * 1000 + r.row_no and (r.y == r.f if r.row_no % 11 else r.y is None) for r in out)
        with pytest.raises(ValueError, match="unlike"):
            files.load_aligned(spark, paths["x"], paths["y"], "f int, g int", "y int", True, True)
        with pytest.raises(ValueError):
            files.load_aligned(spark, paths["x"], paths["y"][:1], "f int", "y int")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ranking_lines_are_not_lost(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("label\tqid\tf0\n1\t5\t0.5\nNA\t5\t0.5\n\\t6\\t0.25\n2\\t7\\t0.75\n")
    rows = sorted((str(r.label), r.qid, r.f0, r.unread) for r in files.read_ranking(spark, str(tmp_path), 1).collect())
    assert rows == sorted([("1", 5, 0.5, None), ("None", 5, 0.5, "NA\t5\t0.5"), ("None", 6, 0.25, "\\t6\\t0.25"), ("2", 7, 0.75, None)] * 2)


@pytest.mark.parametrize("kind", ["regression", "binary"])
def test_fits_of_cells_are_those_of_rows(spark, kind):
    k = F.col("id")
    y = (k % 10) * 2.0 + F.pmod(F.hash("id"), F.lit(7)) if kind == "regression" else (k % 10 + F.pmod(F.hash("id"), F.lit(7)) > 7).cast("double")
    rows = lambda n: model.assembled(spark.range(n).select("id", (k % 10).alias("a"), F.pmod(F.hash(k % 10, k % 20), F.lit(4)).alias("b"), F.pmod(F.hash("id", F.lit(1)), F.lit(3)).cast("int").alias("fold"), y.alias("label")), ["a", "b"])
    given = {"num_boost_round": 3, "max_depth": 3, "learning_rate": 0.5, "min_data_in_leaf": 100}
    df = rows(800)
    summed = model.cells(df, kind)
    assert summed.count() <= 40 and model.cells(rows(4000), kind).count() <= 40  # different features, not rows
    plain, fitted = model.booster(kind, given).fit(df), model.fit_weighted(kind, given)(summed)
    one, two = ([r.score for r in model.score(m, df).orderBy("id").collect()] for m in (plain, fitted))
    assert two == pytest.approx(one) and len(set(one)) > 2
    assert all(t.numNodes == 1 for t in model.fit_weighted(kind, given | {"min_data_in_leaf": 401})(summed).trees)
    own = model.out_of_fold(df, model.fit_weighted(kind, given), 3, kind=kind).orderBy("id").collect()
    want = model.out_of_fold(df, model.booster(kind, given).fit, 3).orderBy("id").collect()
    assert [r.score for r in own] == pytest.approx([r.score for r in want]) and len(own) == 800
    if kind == "regression":
        linear = lambda w: LinearRegression(labelCol="label", featuresCol="features", regParam=0.3, elasticNetParam=0.5, **w)
        assert list(linear({"weightCol": model.WEIGHT}).fit(summed).coefficients) == pytest.approx(list(linear({}).fit(df).coefficients))
        plain = linear({})
        found = model.cross_validated(df, plain, {"regParam": [0.1, 5.0]}, 3)
        errors = [[model.score(plain.copy({plain.regParam: p}).fit(df.where(F.col("fold") != i)), df.where(F.col("fold") == i)).agg(F.sqrt(F.avg((F.col("score") - F.col("label")) ** 2))).first()[0] for i in range(3)] for p in (0.1, 5.0)]
        assert found.avgMetrics == pytest.approx([sum(e) / 3 for e in errors]) and found.transform(df).count() == 800


def test_mixed_columns_beyond_what_doubles_hold(spark, tmp_path):
    orders = spark.createDataFrame([(1, 10, 100.0), (2, 899_999, 499_993.18), (3, 709_900, 5.0)], "o_orderkey long, o_custkey long, o_totalprice double")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL["mix_columns"]).fetchall())
    got = sorted(map(tuple, QUERIES["mix_columns"](spark, str(tmp_path)).select("id", "exp_mean", "h_mean", "top").collect()))
    assert got == want and got[1][1] == float("inf") and got[0][1] < 10


@pytest.mark.parametrize("name", ["mix_columns", "blend_max", "blend_h_mean", "ensemble_mean"])
def test_blends_of_large_keys_round_as_the_sql(spark, tmp_path, name):
    orders = spark.range(3000).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7_000_003 + 43_000_000_000).alias("o_custkey"), (1000 + F.pmod(F.hash("id"), F.lit(10**7)) / 100).alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(f"select * from ({ORACLE_SQL[name]}) order by id")
    assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(want.columns).orderBy("id").collect()] == want.fetchall()


def test_rounding_of_halves_and_odd_values(spark):
    xs = [0.5, -0.5, 1.5, 2.5, -2.5, 0.25, 1.005, 0.0, None, float("inf"), float("-inf"), 1e308, 4503599627370497.0, 0.49999999999999994]
    values = ", ".join("null" if x is None else f"'{x!r}'::double" for x in xs)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for n in (0, 1, 6):
        want = [r[0] for r in duckdb.connect().sql(f"select round(unnest([{values}]), {n}) as x").fetchall()]
        assert [r.x for r in df.orderBy("i").select(scalar.rounded("x", n).alias("x")).collect()] == want
    assert np.isnan(spark.sql("select double('nan') as x").select(scalar.rounded("x", 6)).first()[0])


def test_few_keys_do_not_move_the_facts(spark, monkeypatch):
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("k"), (F.col("id") * 1.5).alias("x"), F.lit(2.0).alias("y"))
    centers = df.where("k < 2").groupBy("k").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        few = scalar.distance_to_center(df, centers, "k", "x", "y")
        assert "SortMergeJoin" not in (plan := few._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    monkeypatch.setattr(skew, "FEW_KEYS", 1)
    many = scalar.distance_to_center(df, centers, "k", "x", "y")
    assert same(few.withColumn("distance", F.round("distance", 6)), many.withColumn("distance", F.round("distance", 6))) and few.count() == 3000


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["fold_scores", "readings_features"])
def test_facts_are_read_once(spark, name):
    assert not [f for f in QUERIES[name](spark, str(DATA)).inputFiles() if "/lineitem.parquet" in f or "/orders.parquet" in f]


def test_group_stats_of_unknown_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", None), ("b", None), (None, 3.0)], "k string, v double")
    got = {r.k: (r.s_mean, r.s_median) for r in merge.fit_group_stats(df, ["k"], "v", "s").collect()}
    assert got == {"a": (2.0, 1.0), "b": (None, None), None: (3.0, 3.0)}


def test_medians_rest_on_few_values(spark, monkeypatch):
    """Values far from a key's median are summed up; what a misplaced window loses is found again."""
    monkeypatch.setattr(order, "RANGE_ROWS", 20_000)
    k, made = F.col("id"), []
    monkeypatch.setattr(merge, "staged", lambda df: made.append(df.cache()) or made[-1])
    x = F.pmod(F.hash("id"), F.lit(1 << 24)) / 1000
    df = spark.range(60_000).select((k % 2).alias("a"), F.when(k % 5 > 0, k % 2).alias("b"), F.when(k % 101 == 0, None).when(k % 7 == 0, 3.5).otherwise(x).alias("v")).cache()
    want = {(r.a, r.b): (r.m, r.d) for r in df.groupBy("a", "b").agg(F.avg("v").alias("m"), F.percentile("v", 0.5).alias("d")).collect()}
    found = lambda: {(r.a, r.b): (pytest.approx(r.s_mean), pytest.approx(r.s_median)) for r in merge.fit_group_stats(df, ["a", "b"], "v", "s").collect()}
    assert found() == want and len(want) == 4
    few = made[0].where("b is not null")
    assert len(made) == 1 and few.count() < 6000 < df.where("b is not null").distinct().count() and few.agg(F.sum("_n")).first()[0] == 48_000
    off = spark.createDataFrame([(0, 0, 0.0, 1.0), (1, 1, 1e9, 2e9)], "a long, b long, _lo double, _hi double")
    made.clear()
    monkeypatch.setattr(merge, "median_windows", lambda *_: off)
    assert found() == want and len(made) == 2
    monkeypatch.setattr(order, "RANGE_ROWS", 1_000_000)
    assert found() == want and len(made) == 3


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_fold_errors_rest_on_few_values(spark, monkeypatch):
    """Prices far from a group's median are summed up by fold; the errors stay those of the SQL, also where a window is misplaced."""
    con, made = duckdb.connect(), []
    for name in ("orders", "lineitem"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    want = sorted(con.sql(ORACLE_SQL["fold_scores"]).fetchall())
    monkeypatch.setattr(order, "RANGE_ROWS", 2000)
    monkeypatch.setattr(order, "WIDTHS", ((0.15, 50),))
    monkeypatch.setattr(readings, "staged", lambda df: made.append(df.cache()) or made[-1])
    assert sorted(map(tuple, QUERIES["fold_scores"](spark, str(DATA)).collect())) == want
    lines = con.sql("select count(*) from lineitem join orders on l_orderkey = o_orderkey").fetchall()[0][0]
    assert len(made) == 2 and made[0].count() < lines / 2 and made[0].agg(F.sum("_n")).first()[0] == lines
    made.clear()
    monkeypatch.setattr(readings, "median_windows", lambda *_: spark.sql("select 'R' as meter, 3 as month, 0D as _lo, 1D as _hi"))
    assert sorted(map(tuple, QUERIES["fold_scores"](spark, str(DATA)).collect())) == want and len(made) == 4


def test_ranking_lines_do_not_move(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text("label\tqid\tf0\n" + "".join(f"{k % 3}\t{k}\t0.5\n" for k in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        read = files.read_ranking(spark, str(tmp_path), 1)
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan
        assert sorted(r.qid for r in read.collect()) == sorted([*range(400)] * 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_area_over_folds_counts_every_score(spark):
    """Cells stand for their rows, features are made of cells, and scores are not put in bins."""
    k = F.col("id")
    y = (F.pmod(F.hash("id"), F.lit(100)) + k % 61 > 80).cast("double")
    raw = spark.range(9000).select("id", (k % 61).alias("a"), F.when(k % 59 > 0, k % 59).alias("b"), (k % 53).alias("c"), F.pmod(F.hash("id", F.lit(1)), F.lit(2)).cast("int").alias("fold"), y.alias("label"))
    logistic = LogisticRegression(labelCol="label", featuresCol="features", regParam=0.01)
    summed = model.assembled(model.cells(raw, "binary", by=["fold"], of=["a", "b", "c"]), ["a", "b", "c"])
    assert summed.columns == ["a", "b", "c", "fold", "label", model.WEIGHT, "features"] and summed.agg(F.sum(model.WEIGHT)).first()[0] == 9000
    assert same(summed.select("features", "fold", "label", model.WEIGHT), model.cells(model.assembled(raw, ["a", "b", "c"]), "binary", by=["fold"]))
    (got,) = model.cross_validated(summed, logistic, {"regParam": [0.01]}, 2, metric="auc").avgMetrics
    areas = []
    for i in range(2):
        fitted = logistic.copy().setWeightCol(model.WEIGHT).fit(summed.where(F.col("fold") != i))
        scored = model.score(fitted, model.assembled(raw.where(F.col("fold") == i), ["a", "b", "c"])).select("score", "label").cache()
        assert scored.select("score").distinct().count() > 2000  # more than the bins of the evaluator's default
        areas.append(evaluate.auc(scored, "score", "label").first()["auc"])
    assert got == pytest.approx(sum(areas) / 2, abs=1e-8)
    with pytest.raises(ValueError, match="no cells"):
        model.cross_validated(summed, LinearRegression(labelCol="label"), {"regParam": [0.1]}, 2, metric="mae")


def test_early_stopping_takes_cells_of_one_pass(spark):
    """Training and held-out cells of one table give the rows' errors; the rows are passed over once."""
    k, passed = F.col("id"), spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            passed.add(len(part))
            yield part

    raw = spark.range(3000).select("id", (k % 11).alias("a"), (k % 7).alias("b"), F.pmod(F.hash("id"), F.lit(3)).cast("int").alias("fold"), (k % 11 * 2.0 + F.pmod(F.hash("id", F.lit(1)), F.lit(9))).alias("label"))
    counted = raw.mapInPandas(count, raw.schema)
    given = {"num_boost_round": 4, "max_depth": 2, "learning_rate": 0.5, "early_stop": 2, "metric": "rmse"}
    with model.held(model.assembled(model.cells(counted, "regression", by=["fold"], of=["a", "b"]), ["a", "b"])) as data:
        fitted, best, errors = model.fit_early("regression", given, data.where("fold <> 0"), data.where("fold = 0"))
    assert passed.value == 3000
    rows = model.assembled(raw, ["a", "b"])
    plain = model.booster("regression", given).fit(rows.where("fold <> 0"))
    assert errors == pytest.approx([e**0.5 for e in plain.evaluateEachIteration(rows.where("fold = 0"), "squared")]) and best == 1 + errors.index(min(errors))
    for bad in ({"metric": "mae"}, {"subsample": 0.5}):
        with pytest.raises(ValueError, match="no cells"):
            model.fit_early("regression", given | bad, data.where("fold <> 0"), data.where("fold = 0"))


def test_lasso_cascade_takes_cells(spark):
    k = F.col("id")
    raw = spark.range(2000).select("id", (k % 13).alias("a"), (k % 7).alias("b"), (k % 13 * 2.0 + (k % 7) * (k % 7) + F.pmod(F.hash("id"), F.lit(9))).alias("label"))
    given, rows = {"num_boost_round": 3, "max_depth": 2, "learning_rate": 0.5}, model.assembled(raw, ["a", "b"])
    summed = model.assembled(model.cells(raw, "regression", of=["a", "b"]), ["a", "b"])
    assert summed.count() <= 2 * 91
    one, two = ([r.score for r in model.lasso_cascade(train, rows, given, 0.1).orderBy("id").collect()] for train in (rows, summed))
    linear = LinearRegression(labelCol="label", featuresCol="features", elasticNetParam=1.0, regParam=0.1, predictionCol="l").fit(rows)
    rest = model.booster("regression", given, "rest").fit(linear.transform(rows).withColumn("rest", F.col("label") - F.col("l")))
    plain = [r.l + r.prediction for r in rest.transform(linear.transform(rows)).orderBy("id").collect()]
    assert one == pytest.approx(plain) and two == pytest.approx(plain) and len(set(plain)) > 20


def test_robust_scale_of_cells_is_that_of_rows(spark):
    k = F.col("id")
    raw = spark.range(2000).select("id", F.when(k % 9 > 0, F.pmod(F.hash("id"), F.lit(23))).alias("a"), (k % 7 * k % 5).alias("b"), F.lit(None).cast("int").alias("c"), (k % 31).alias("label"))
    summed = model.cells(raw, "regression", of=["a", "b", "c"])
    assert summed.count() < 1000
    rows, cells = scalar.fit_robust(raw, ["a", "b", "c"]).collect(), scalar.fit_robust(summed, ["a", "b", "c"], weight=model.WEIGHT).collect()
    assert cells == rows and cells[0]["_s_a"] > 1 and cells[0]["_m_c"] is None
    with pytest.raises(ValueError):
        scalar.fit_robust(summed, ["a"], 100, model.WEIGHT)
