"""Row numbers within a few large groups, given out by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stored


def row_numbers(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`, numbers from 1 on in each group by the order.

    Rows are sorted into ranges, and each range is numbered by itself from where the ranges before it end, which takes one row for each range and group. A window
    over the group would be one task's work, however large the group.
    """
    parts = stored(df.repartitionByRange(*groups, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy(*groups, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    on = [parts[c].eqNullSafe(before[c]) for c in (*groups, "_p")]
    joint = on[0]
    for c in on[1:]:
        joint = joint & c
    own = F.row_number().over(W.partitionBy(*[parts[c] for c in (*groups, "_p")]).orderBy(*[parts[c] for c in order]))
    return parts.join(before, joint).select(*[parts[c] for c in df.columns], (own + before["_b"]).cast("long").alias(name))
