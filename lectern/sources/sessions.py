"""Sessions as partitions of a table: write, read, drop, retain; reports as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    """Write rows by session; sessions in ``df`` replace their earlier state, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_id").parquet(path)


def load(spark: SparkSession, path: str, chat_id: str) -> DataFrame:
    """The rows of one session; only its folder is read."""
    return spark.read.parquet(path).where(F.col("chat_id") == chat_id)


def expired(sessions: DataFrame, now: str, minutes: int = 120) -> DataFrame:
    """Sessions that nobody has touched for longer than the time given; a session without a time of use isn't one."""
    idle = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))
    return sessions.where(idle > minutes * 60 * 1_000_000)


def retain(log: DataFrame, key: str, order: list[str], most: int = 50) -> DataFrame:
    """The last entries of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def markdown(df: DataFrame, columns: list[str], title: str, most: int = 1_000) -> str:
    """A table of at most ``most`` rows as Markdown; bars in cells are escaped, nulls are dashes. A larger table is no report: it raises an error and is to be written as a file."""
    cell = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("–"))
    rows = [r.line for r in df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line")).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return "\n".join([f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "|".join("---" for _ in columns) + "|", *rows]) + "\n"
