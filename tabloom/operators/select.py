"""Projections, filters, splits and samples. Every split and sample follows a key, never a row's place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.keys import BUCKETS, bucket
from tabloom.operators import encode

#: Strict bounds of the integer types, narrowest first.
INT_TYPES = (("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 63))
#: The greatest float.
FLOAT_MOST = 3.4028234e38
#: Columns in one aggregate, which keeps generated code within its limits.
CHUNK = 200


def features(df: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """All columns but the excluded ones."""
    return df.select([c for c in df.columns if c not in set(excluded)])


def drop_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; unknown counts as not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def split_by_value(c: str, train_below: int, valid: int, test: int) -> Column:
    """train, valid or test by a time block; null for other blocks."""
    x = F.col(c)
    return F.when(x < train_below, "train").when(x == valid, "valid").when(x == test, "test")


def holdout_with_gap(df: DataFrame, block: str, gap: int = 1) -> DataFrame:
    """Adds split: test at the last block, train before the gap, else null."""
    last = df.agg(F.max(block).alias("_last"))
    split = F.when(F.col(block) == F.col("_last"), "test").when(F.col(block) < F.col("_last") - gap, "train")
    return df.crossJoin(F.broadcast(last)).withColumn("split", split).drop("_last")


def pick_samples(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer), by a hash of the key."""
    return df.orderBy(bucket(key, seed), key).limit(n)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.where(bucket(key, seed) < int(fraction * BUCKETS))


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(min, max) of many columns, one row for each: (column, lo, hi)."""
    parts = []
    for at in range(0, len(columns), CHUNK):
        some = columns[at : at + CHUNK]
        row = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in some for n, f in (("lo", F.min), ("hi", F.max))))
        parts.append(row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi")) for c in some))).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_constant): no two known values differ."""
    return spread(df, columns).select("column", (F.coalesce("lo", F.lit(0.0)) == F.coalesce("hi", F.lit(0.0))).alias("is_constant"))


def dominant_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, share): the share of each column's most common value among all rows; nulls are a value."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = cells.groupBy("column", "value").count()
    return counts.groupBy("column").agg((F.max("count") / F.sum("count")).alias("share"))


def head_tail(df: DataFrame, key: str, n_test: int, name: str = "split") -> DataFrame:
    """Adds split: test for the n_test rows of the greatest keys (all, if fewer), else train. Keys should be unique."""
    cut = df.orderBy(F.desc(key)).limit(n_test).agg(F.min(key).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.when(F.col(key) < F.col("_cut"), "train").otherwise("test")).drop("_cut")


def index_split(df: DataFrame, key: str, index: DataFrame, row: str = "row_no", split: str = "split") -> DataFrame:
    """The rows that an index of (row, split) names, with their split."""
    return df.join(index.select(F.col(row).alias("_row"), split), F.col(key) == F.col("_row")).drop("_row")


def narrow_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, lo, hi, type): the narrowest type whose bounds lie strictly outside the values.

    Fractions become float, or double where float would overflow. Strings become `category`, codes over sorted levels.
    Booleans, times and other types stay what they are; they and strings have no bounds.
    """
    kinds = dict(df.dtypes)
    whole = [c for c in columns if kinds[c] in {t for t, _ in INT_TYPES}]
    fractions = [c for c in columns if kinds[c] in ("float", "double") or kinds[c].startswith("decimal")]
    rest = [(c, "category" if kinds[c] == "string" else kinds[c]) for c in columns if c not in {*whole, *fractions}]
    fits = F.lit("bigint")
    for name, bound in reversed(INT_TYPES[:-1]):
        fits = F.when((F.col("lo") > -bound) & (F.col("hi") < bound - 1), name).otherwise(fits)
    held = F.coalesce((F.col("lo") > -FLOAT_MOST) & (F.col("hi") < FLOAT_MOST), F.lit(True))
    fraction = F.when(held, "float").otherwise("double")
    out = [spread(df, [*whole, *fractions]).withColumn("type", F.when(F.col("column").isin(whole), fits).otherwise(fraction))] if whole or fractions else []
    if rest:
        none = F.lit(None).cast("double")
        out.append(df.sparkSession.createDataFrame(rest, "column string, type string").select("column", none.alias("lo"), none.alias("hi"), "type"))
    return reduce(DataFrame.unionByName, out)


def apply_types(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cast the columns as narrow_types() says; that table has a row for each column. Categories become codes, -1 for null."""
    rows = chosen.collect()
    out = df.withColumns({r["column"]: F.col(r["column"]).cast(r["type"]) for r in rows if r["type"] != "category"})
    for r in rows:
        if r["type"] == "category":
            c = r["column"]
            out = encode.apply_codes(out, encode.fit_labels(df, c), c, "_code", -1).withColumn(c, F.col("_code")).drop("_code")
    return out.select(df.columns)
