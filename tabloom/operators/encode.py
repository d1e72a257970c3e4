"""Category encoders. fit_* return a table of one row per level; apply_* join it to any split.

A fitted table is as large as the column has levels, so it is joined without a broadcast hint: Spark broadcasts it where
its size, known after the shuffle, allows. Its column _rows says how many rows a level had in the fit; levels that had
more than their share, and nulls, are dealt out in the join (dealt_join). Many columns are applied by apply_levels().
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.order import global_row_number
from tabloom.operators.skew import checked_join, dealt_join

#: Levels that one-hot encoding turns into columns at most.
MAX_LEVELS = 1000
#: Levels of a column that apply_levels() broadcasts at most, and large columns that it joins one by one.
FEW_LEVELS, ONE_BY_ONE = 100_000, 2


def _join(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    return dealt_join(df, fitted.withColumnRenamed("level", column), [column], rows="_rows" if "_rows" in fitted.columns else None)


def _counted(df: DataFrame, column: str) -> DataFrame:
    """(level, _rows) of known values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("_rows"))


def apply_levels(df: DataFrame, fitted: DataFrame, names: dict[str, dict[str, str]], key: str | None = None) -> DataFrame:
    """Adds values of a long fitted table (column, level as text, values, _rows) to many columns; names has {column: {value: name}}.

    Columns of FEW_LEVELS levels or fewer are broadcast, which a count has checked, so they do not move the facts. Further
    ones, if they are more than ONE_BY_ONE and `key` tells rows apart, are looked up together in a table of (key, column,
    level) that is brought back to one row a key: the facts move once, whatever their number.
    """
    sizes = {r["column"]: r["count"] for r in fitted.groupBy("column").count().collect()}  # a row for each column
    few = [c for c in names if sizes.get(c, 0) <= FEW_LEVELS]
    many = [c for c in names if c not in few]
    out = df
    for c in [*few, *(many if key is None or len(many) <= ONE_BY_ONE else [])]:
        one = fitted.where(F.col("column") == c).select(F.col("level").alias("_level"), *(F.col(v).alias(n) for v, n in names[c].items()), "_rows")
        if c in few:
            out = out.join(F.broadcast(one.drop("_rows")), F.col(c).cast("string") == F.col("_level"), "left").drop("_level")
        else:
            out = dealt_join(out.withColumn("_level", F.col(c).cast("string")), one, ["_level"], rows="_rows").drop("_level")
    if key is not None and len(many) > ONE_BY_ONE:
        cells = df.select(F.col(key).alias("_key"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in many)))).where("level is not null")
        met = dealt_join(cells, fitted.where(F.col("column").isin(many)), ["column", "level"], "inner", "_rows")
        wide = met.groupBy("_key").agg(*(F.max(F.when(F.col("column") == c, F.col(v))).alias(n) for c in many for v, n in names[c].items()))
        out = out.join(wide, F.col(key) == F.col("_key"), "left").drop("_key")
    return out.select(*df.columns, *(n for c in names for n in names[c].values()))


def fit_ordinal(train: DataFrame, column: str) -> DataFrame:
    """(level, code, _rows): 1 for the most frequent known value, ties by value."""
    return global_row_number(_counted(train, column), -F.col("_rows"), "level").select("level", (F.col("row_no") + 1).cast("int").alias("code"), "_rows")


def fit_labels(df: DataFrame, column: str, classes: int | None = None) -> DataFrame:
    """(level, code, _rows): classes in order from 0. Another number of classes than the one given is an error."""
    levels = _counted(df, column)
    if classes is not None and (found := levels.limit(classes + 1).count()) != classes:
        raise ValueError(f"{column} has {'over ' if found > classes else ''}{min(found, classes)} classes; {classes} are asked for")
    return global_row_number(levels, "level").select("level", F.col("row_no").cast("int").alias("code"), "_rows")


def apply_codes(df: DataFrame, fitted: DataFrame, column: str, name: str, missing: int | None = None, check: bool = False) -> DataFrame:
    """Adds the code of each level; unseen levels and nulls get `missing`. `check` counts the levels first, so that few do not move df."""
    named = fitted.withColumnRenamed("code", name)
    out = checked_join(df, named.withColumnRenamed("level", column).drop("_rows"), [column]) if check else _join(df, named, column)
    return out if missing is None else out.withColumn(name, F.coalesce(name, F.lit(missing)))


def fit_factors(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(level, code, _rows) over both tables."""
    return fit_labels(train.select(column).unionByName(test.select(column)), column)


def fit_frequency(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, share, _rows) of all columns in one pass over both tables; nulls count nowhere."""
    both = train.select(*columns).unionByName(test.select(*columns))
    cells = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns))).alias("x")).select("x.*")
    counts = cells.where("level is not null").groupBy("column", "level").count()
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "column").select("column", "level", (F.col("count") / F.col("total")).alias("share"), F.col("count").alias("_rows"))  # a row for each column


def apply_frequency(df: DataFrame, fitted: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Adds {column}_freq of all columns; `key`, a column that tells rows apart, lets many large columns move the facts once."""
    return apply_levels(df, fitted, {c: {"share": f"{c}_freq"} for c in columns}, key)


def count_encode(df: DataFrame, column: str) -> DataFrame:
    """Adds {column}_counts, the rows that hold the value; null for null."""
    return _join(df, _counted(df, column).withColumn(f"{column}_counts", F.col("_rows")), column)


def fit_target_mean(train: DataFrame, column: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(level, mean, _rows) of levels seen twice or more, and the global mean in one row."""
    sums = train.groupBy(F.col(column).alias("level")).agg(F.count(target).alias("n"), F.sum(target).alias("s"), F.count("*").alias("_rows"))
    return sums.where("n > 1 and level is not null").select("level", (F.col("s") / F.col("n")).alias("mean"), "_rows"), train.agg(F.avg(target).alias("overall"))


def apply_target_mean(df: DataFrame, fitted: tuple[DataFrame, DataFrame], column: str, name: str) -> DataFrame:
    out = _join(df, fitted[0], column).crossJoin(F.broadcast(fitted[1]))
    return out.withColumn(name, F.coalesce("mean", "overall")).drop("mean", "overall")


def collapse_rare(df: DataFrame, column: str, most: int, other: str = "Other") -> DataFrame:
    """Levels of `most` rows or fewer, and nulls, become one level."""
    keep = _counted(df, column).where(F.col("_rows") > most).withColumn("_keep", F.lit(True))
    return _join(df, keep, column).withColumn(column, F.when(F.col("_keep"), F.col(column)).otherwise(other)).drop("_keep")


def keyword_class(c: str, words: Sequence[tuple[str, str]], default: str) -> Column:
    """The class of the first word that the text contains; the default for null, null where none fits."""
    found = F.coalesce(*(F.when(F.contains(F.col(c), F.lit(w)), F.lit(v)) for w, v in words))
    return F.when(F.col(c).isNull(), F.lit(default)).otherwise(found)


def token(c: str, k: int) -> Column:
    """The k-th word, null if there is none."""
    return F.get(F.split(F.trim(F.col(c)), r"\s+"), k)


def cross(*columns: str) -> Column:
    return F.concat_ws("_", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns))


def lookup(c: str, known: dict[str, float]) -> Column:
    """The value of a literal map; null for null and what it lacks."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col(c))


def between_flag(x: Column, above: float | None = None, below: float | None = None) -> Column:
    """1 where the value lies strictly between the bounds given, else 0; null is 0."""
    held = [x > above] * (above is not None) + [x < below] * (below is not None)
    return F.coalesce(reduce(Column.__and__, held, F.lit(True)) & x.isNotNull(), F.lit(False)).cast("int")


def equal_flag(a: str, b: str) -> Column:
    """1 where both are known and equal, else 0."""
    return F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")


def one_hot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces each column by a 0/1 column for each level, in order. Null has no 1. Levels are bounded by MAX_LEVELS."""
    made = {}
    for c in columns:
        levels = [r[0] for r in df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        made |= {f"{c}_{v}": F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("int") for v in levels}
    return df.withColumns(made).drop(*columns)


def distinct_elements(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """(element): distinct parts of a delimited column."""
    return df.select(F.explode(F.split(F.trim(F.col(column).cast("string")), separator)).alias("element")).distinct()
