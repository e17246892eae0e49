"""Connected components by alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: larger neighbours go to the least one. Small star: the node and its smaller neighbours do.

    The least neighbour is a grouped minimum, combined before the shuffle, so that a node with very many neighbours is no group of one task.
    """
    if small:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = pairs.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a != b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each end of edges (a, b); root is the least node of its component. Null ends and loops don't count.

    Each round is a table in the shared folder, of which only the last stays; the rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch(spark, name)
        df.write.option("compression", "snappy").parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, edges = kept(edges.filter("a is not null and b is not null and a != b").distinct())
    last = None
    while True:
        old, (path, edges) = path, kept(_star(_star(edges, False), True))
        discard(spark, old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first()
        if now == last or not now[0]:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
