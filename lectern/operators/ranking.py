"""Numbering of ordered rows by group, without one task sorting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import small, stored


def numbered(df: DataFrame, key: str | None, order: list[Column], name: str) -> DataFrame:
    """The rows with their place (from 1) in the order of their group; without a key all rows are one group.

    Rows are partitioned by range of group and order, so that a group of any size is spread over tasks; each task numbers its own part of a group, and what stands before is added from
    the counts of the parts, of which there are as many as tasks. The order has to be total for a fixed result: ties are numbered in any order. Null keys are a group; an empty table gives an empty result.
    The columns _g, _part and _n are taken.
    """
    g = F.col(key).cast("string") if key else F.lit(None).cast("string")
    keys = [F.col(key).asc_nulls_first(), *order] if key else order
    # Written once, as a part computed anew could get other bounds.
    parts = stored(df.withColumn("_g", g).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    inside = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_g", "_part").orderBy(*order)))
    counts = parts.groupBy("_g", "_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("_g").alias("_og"), F.col("_part").alias("_op"), before.alias("_before"))
    # Only groups in more than one part have anything before; those are few.
    joined = inside.join(small(offsets.where("_before > 0")), F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_part") == F.col("_op")), "left")
    return joined.withColumn(name, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_g", "_part", "_n", "_og", "_op", "_before")
