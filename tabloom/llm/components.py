"""Connected components of links between documents, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import discard, written


def _star(sym: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of each node to the least of the node and its neighbours."""
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sym.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v < u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u").select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge, label being the smallest node that it reaches.

    Every round is written to the shared folder, so a lost executor costs one round; links never reach the driver, which
    only compares a count and a checksum. Loops, null ends and repeated edges are ignored.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct(), "edges")
    seen = None
    while True:
        big = _star(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True).where("u != v").distinct()
        step = _star(big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).where("u != v").distinct()
        then = written(step, "edges")
        mark = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
