"""Every query against its SQL on the smallest tables, and the driver's contract without the text operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(REPO))

from tabloom.jobs.registry import ORACLE_SQL, QUERIES  # noqa: E402

FITS = {"gbt_regression", "gbt_binary", "early_stopping", "lasso_cascade", "oof_predictions", "feature_importance", "forward_selection", "grid_search", "linear_cv", "stack_oof", "grid_search_auc", "oof_test_mean", "multi_target_fit", "ensemble_models", "gbt_categorical", "pipeline_readings", "pipeline_stops", "pipeline_binary"}


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if type(v).__name__.startswith("bool"):
        return str(bool(v))
    if type(v).__name__.startswith(("int", "float")):
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    return str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), tables.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_are_models():
    assert set(QUERIES) - set(ORACLE_SQL) == FITS


def test_entry_imports_without_the_text_operators(tmp_path):
    for part in ("__spark_entry__.py", "tabloom"):
        (tmp_path / part).symlink_to(REPO / part) if part.endswith(".py") else (tmp_path / part).mkdir()
    for part in (REPO / "tabloom").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "tabloom" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    entry = tmp_path / "__spark_entry__.py"
    text = entry.read_text()
    entry.unlink()
    entry.write_text(text)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.parametrize("part", sorted(p.stem for p in (REPO / "tabloom/jobs").glob("*.py") if p.stem != "__init__"))
def test_any_job_module_may_be_the_first(part):
    subprocess.run([sys.executable, "-c", f"import tabloom.jobs.{part}"], cwd=REPO, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pipelines_end_in_sound_scores(spark):
    readings = QUERIES["pipeline_readings"](spark, str(DATA)).collect()
    lines = spark.read.parquet(str(DATA / "lineitem.parquet"))
    n_test = lines.where("l_orderkey % 5 = 4").count()
    assert sum(r.n for r in readings) == lines.count() and {r.fold: r.n for r in readings}[-1] == n_test
    assert sorted(r.fold for r in readings) == [-1, 0, 1, 2] and all(r.rmse < 0.6 * r.mean_rmse for r in readings)  # a signal is planted
    stops = QUERIES["pipeline_stops"](spark, str(DATA)).collect()
    assert len(stops) % 3 == 0 and len({r.target_id for r in stops}) == len(stops) > 0
    (binary,) = QUERIES["pipeline_binary"](spark, str(DATA)).collect()
    assert binary.n > 0 and binary.rounds >= 1 and 0 <= binary.auc <= 1
