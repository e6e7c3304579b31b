"""Greedy absorption along edges in a fixed order, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.shared import stored


def absorb(edges: DataFrame) -> DataFrame:
    """(id, target) of the nodes that an earlier node takes in, from edges (earlier, later).

    A node is taken in if it has an edge to an earlier node that isn't itself taken in; its target is the smallest such. In each round all nodes are decided whose earlier neighbours
    are all decided (or one of which stands for itself and no smaller one is open); the rounds needed are the length of the longest chain, whatever the number of rows.
    Null ends and edges to itself drop out, repeated edges change nothing, an empty table gives an empty result.
    """
    e = stored(edges.select(F.least("earlier", "later").alias("a"), F.greatest("earlier", "later").alias("b")).where("a < b").distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    firsts = nodes.join(e.select(F.col("b").alias("id")), "id", "left_anti")
    done = stored(firsts.select("id", F.lit(None).cast("long").alias("target")))
    while True:
        open_ = e.join(done.select(F.col("id").alias("b")), "b", "left_anti")
        state = open_.join(done.withColumnsRenamed({"id": "a", "target": "t"}).withColumn("known", F.lit(True)), "a", "left")
        # Undecided neighbours hold a node back, unless a smaller one already stands for itself.
        seen = state.groupBy("b").agg(F.min(F.when(F.col("known") & F.col("t").isNull(), F.col("a"))).alias("root"), F.min(F.when(F.col("known").isNull(), F.col("a"))).alias("wait"))
        fresh = stored(seen.where("wait is null or root < wait").select(F.col("b").alias("id"), F.col("root").alias("target")))
        if fresh.isEmpty():
            return done.where("target is not null")
        done = stored(done.unionByName(fresh))
