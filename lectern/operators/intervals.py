"""Sweep line over intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Merge the integer intervals [start, end] (both included) of each key: rows (key, kind, first, last), kind ``period`` or ``gap``.

    Every interval becomes a +1 at its start and a -1 after its end. The events are summed per key and point before the shuffle (map-side), so
    a key holds at most one row per distinct point however many intervals it has; a running sum over the points then gives the number of
    intervals that are open, and only points where it leaves or reaches zero are kept. Adjacent intervals cancel at the shared point and merge.
    Intervals with a null key, start or end, or ending before they start, are ignored; repeated intervals change nothing; an empty input
    gives an empty result. Columns besides the three named are ignored, whatever their names.
    """
    events = (
        df.select(F.col(key).alias("_k"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
        .where("_k is not null and _s is not null and _e >= _s")
        .select("_k", F.explode(F.array(F.struct(F.col("_s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("_e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("_x"))
        .groupBy("_k", F.col("_x.at").alias("_at"))
        .agg(F.sum("_x.d").alias("_d"))
    )
    w = Window.partitionBy("_k").orderBy("_at")
    turns = (
        events.select("_k", "_at", "_d", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_open"))
        .where((F.col("_open") == 0) | (F.col("_open") == F.col("_d")))
        .where("_d <> 0")
    )
    spans = turns.select("_k", "_open", "_at", F.lead("_at").over(w).alias("_next")).where("_next is not null")
    return spans.select(
        F.col("_k").alias(key),
        F.when(F.col("_open") > 0, "period").otherwise("gap").alias("kind"),
        F.col("_at").alias("first"),
        (F.col("_next") - 1).alias("last"),
    )
