"""Text sources and sinks with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.skew import dealt_join


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV files with a header. Compressed files are read by their extension; gzip files are not split, so repartition after."""
    return spark.read.schema(schema).option("header", True).csv(paths if isinstance(paths, str) else list(paths))


def write_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.option("header", True).option("compression", compression or "none").csv(path)


def read_labelled(spark: SparkSession, paths: str | Sequence[str], n_features: int) -> DataFrame:
    """Files without header: an int label, then floats f0, f1, ..."""
    schema = T.StructType([T.StructField("label", T.IntegerType()), *(T.StructField(f"f{k}", T.FloatType()) for k in range(n_features))])
    return spark.read.schema(schema).option("header", False).csv(paths if isinstance(paths, str) else list(paths))


def lines_by_place(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, line_no, value): every line with its number in its file, from 0; a file is named by its path.

    A file is read in blocks by several tasks. Lines of a block come in order, so a line's number is its place in the block
    and the lines of the blocks before, which a small table of the blocks' counts tells. Quoted line feeds end a line.
    """
    read = spark.read.text(paths if isinstance(paths, str) else list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = read.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.col("_n").alias("_rows"))
    return dealt_join(read, before, ["file", "_block"], "inner", "_rows").select("file", (F.col("_at") + F.col("_shift")).alias("line_no"), "value")


def read_ranking(spark: SparkSession, path: str, n_features: int, header: bool = True) -> DataFrame:
    """Tab-separated label, qid and features, where a tab may be written as a backslash and a t; the first line of each file is skipped.

    Every other line is a row; what is unreadable in it is null, and `unread` is the line itself where the label or the
    query id is.
    """
    if header:
        read = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("_metadata.file_path").alias("_file"))
        first = read.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_at")).select("_at")
        lines = read.join(F.broadcast(first), "_at", "left_anti").select("value")  # a row for each file
    else:
        lines = spark.read.text(path)
    rows = lines.select("value", F.split(F.replace("value", F.lit("\\t"), F.lit("\t")), "\t").alias("p"))
    at = lambda k, t: F.expr(f"try_cast(get(p, {k}) as {t})")
    label, qid = at(0, "double").cast("int"), at(1, "bigint")
    unread = F.when(label.isNull() | qid.isNull(), F.col("value"))
    return rows.select(label.alias("label"), qid.alias("qid"), *(at(k + 2, "double").alias(f"f{k}") for k in range(n_features)), unread.alias("unread"))


def read_libsvm(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """label and features; a label of -1 becomes 0."""
    df = spark.read.format("libsvm").option("numFeatures", n_features).load(path)
    return df.withColumn("label", F.when(F.col("label") == -1, 0.0).otherwise(F.col("label")))


def load_parts(spark: SparkSession, features: Sequence[str], labels: Sequence[str], feature_schema: str, label_schema: str, key: str) -> DataFrame:
    """Numbered pairs of feature and label files, joined on (part, key). Both files of a part hold the key."""
    def parts(paths: Sequence[str], schema: str) -> DataFrame:
        out = None
        for k, p in enumerate(paths):
            one = read_csv(spark, p, schema).withColumn("part", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    return parts(features, feature_schema).join(parts(labels, label_schema), ["part", key])


def load_aligned(spark: SparkSession, features: Sequence[str], labels: Sequence[str], feature_schema: str, label_schema: str, feature_header: bool = True, label_header: bool = True) -> DataFrame:
    """Numbered pairs of CSV files without a stored key, joined by place: row k of a part's features with row k of its labels.

    Adds part and row_no. A file of either kind may have a header line. An error if a part's files differ in rows.
    """
    names = lambda paths: [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if len(features) != len(labels) or len(set(names(features))) < len(features) or len(set(names(labels))) < len(labels):
        raise ValueError("parts are pairs of files, and files of a kind need names of their own")

    def rows(paths: Sequence[str], schema: str, header: bool) -> DataFrame:
        parts = spark.createDataFrame(list(enumerate(names(paths))), "part int, file string")  # a row for each file
        placed = lines_by_place(spark, paths).withColumn("file", F.substring_index("file", "/", -1)).join(F.broadcast(parts), "file")
        if header:
            placed = placed.where("line_no > 0").withColumn("line_no", F.col("line_no") - 1)
        return placed.select("part", F.col("line_no").alias("row_no"), F.from_csv("value", schema).alias("_row")).select("part", "row_no", "_row.*")

    left, right = rows(features, feature_schema, feature_header), rows(labels, label_schema, label_header)
    counts = left.groupBy("part").agg(F.count("*").alias("x")).join(right.groupBy("part").agg(F.count("*").alias("y")), "part", "full")
    if odd := [r["part"] for r in counts.where("x is distinct from y").collect()]:  # a row for each part at most
        raise ValueError(f"parts {sorted(odd)} have unlike numbers of rows")
    return left.join(right, ["part", "row_no"])


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, which make() fills the first time. Only a finished write is reused."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_submission(df: DataFrame, path: str, key: str, value: str, decimals: int = 4, compression: str | None = "gzip") -> None:
    """id and prediction with fixed decimals."""
    write_csv(df.select(F.col(key).alias("id"), F.format_string(f"%.{decimals}f", F.col(value)).alias("target")), path, compression)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split."""
    df.write.partitionBy(split).parquet(path)
