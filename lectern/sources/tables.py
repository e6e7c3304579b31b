"""Reading the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: list[str], keep: dict[str, Column] | list[str]) -> DataFrame:
    """One row per key: the one that is greatest by ``order`` (nulls lowest); only ``keep`` is shuffled.

    Rows without a key are left out. Rows equal in all of ``order`` are re-deliveries of one row; which of them is kept is open.
    """
    cols = keep if isinstance(keep, dict) else {c: F.col(c) for c in keep}
    picked = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in order]).alias("_o"), F.struct(*[c.alias(n) for n, c in cols.items()]).alias("_v"))
        .groupBy("_k")
        .agg(F.max_by("_v", "_o").alias("_v"))
    )
    return picked.select(F.col("_k").alias(key), "_v.*")


def current_profiles(spark: SparkSession, sf_dir: str, keep: dict[str, Column] | list[str]) -> DataFrame:
    """The current row (highest revision) of each profile, with only the columns of ``keep``."""
    return latest(table(spark, sf_dir, "profiles"), "profile_id", ["revision", "ingested_at"], keep)
