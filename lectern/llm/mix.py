"""Sources mixed to target shares: pivotal dependent rounding of fractional copy numbers, residuals combined through a reduction tree."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.tokens import TOKENIZER, WORDS, count_tokens
from lectern.sources.shared import small, stored

#: Items that one task rounds, on average, and residuals that one task of the next level of the tree combines.
SHARD_ITEMS, FAN_IN = 20_000, 1_000


def pivotal(sizes: list[int], odds: list[float], rng: random.Random) -> tuple[list[int | None], int | None, float]:
    """Round odds in (0, 1) to 0 or 1 pair by pair, keeping the expected size; -> (choices, the residual's place, its odds).

    Of a pair, size is moved from one to the other until one is 0 or 1: in one of two directions, with the chance that leaves both odds as they
    were in expectation. The sum of size times choice never changes but for the one item that stays fractional, whose choice is None.
    """
    out: list[int | None] = [None] * len(sizes)
    held, p = None, 0.0
    for j, q in enumerate(odds):
        if held is None:
            held, p = j, q
        else:
            a, b = sizes[held], sizes[j]
            up = min((1 - p) * a, q * b)  # size that can go to the held item
            down = min(p * a, (1 - q) * b)  # size that can go to the other
            move = up if rng.random() * (up + down) < down else -down
            p, q = p + move / a, q - move / b
            eps = 1e-9
            for k, x in ((held, p), (j, q)):
                if x < eps or x > 1 - eps:
                    out[k] = int(x > 0.5)
            held, p = (held, p) if out[held] is None else (j, q) if out[j] is None else (None, 0.0)
        if held is not None and not 1e-9 <= p <= 1 - 1e-9:
            out[held] = int(p > 0.5)
            held = None
    return out, held, p


def copies(df: DataFrame, id_col: str, source_col: str, size_col: str, targets: DataFrame, *, total: float | None = None, seed: int = 0) -> DataFrame:
    """(id, source, size, copies) of the items taken into the mix, copies >= 1.

    targets: (source, target_share, max_repeats), small. Shares are taken relative to their sum. total: size of the mix; by default the largest that
    reaches every share without repeating any item more than its source's max_repeats times. With a larger total the capped sources stay at their cap.
    A source's items all have share * total / size of source expected copies: the whole part is certain, the rest is rounded by ``pivotal`` in shards
    of each source (by a hash of the id, so that a source of any size is spread), and the one residual of each shard goes on, FAN_IN to a task, until
    one per source is left, which is drawn. A source's size so misses its share by less than one item. The sizes are stored once in the shared folder.
    Items without a source, or of a source without a target, are left out, as are null ids, null sizes and sizes below 1; rows with the same id are one
    item; targets of sources without items take no share. Null max_repeats mean 1. Other columns aren't read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    t = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    items = stored(
        df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("int").alias("size"))
        .where("id is not null and size > 0")
        .join(small(t), "source")
        .groupBy("id")
        .agg(F.max(F.struct("size", "source", "share", "cap")).alias("x"))
        .select("id", "x.*")
    )
    held = items.groupBy("source").agg(F.sum("size").alias("held"), F.count("*").alias("n"), F.first("share").alias("share"), F.first("cap").alias("cap"))
    sums = held.agg(F.sum("share").alias("share"), F.min(F.col("cap") * F.col("held") / F.col("share")).alias("most"), F.max("n").alias("n")).first()
    if sums.n is None:
        return spark_empty(df, kind)
    mix = total * 1.0 if total is not None else sums.most * sums.share
    level0 = max(1, round(sums.n / SHARD_ITEMS))
    rate = F.least(F.col("share") / sums.share * mix / F.col("held"), F.col("cap").cast("double"))
    rated = items.join(F.broadcast(held.select("source", "held")), "source")
    rated = rated.withColumn("rate", rate).select(
        "id", "source", "size", F.floor("rate").cast("int").alias("sure"), (F.col("rate") - F.floor("rate")).alias("odds"), F.pmod(F.xxhash64("id"), F.lit(level0)).cast("int").alias("shard")
    )
    shape = f"id {kind}, source string, size int, sure int, odds double, shard int, taken int"

    def rounds(last: bool):
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("id", ignore_index=True)
            rng = random.Random(f"{seed}/{key[0]}/{key[1]}/{last}")
            size, odds = g["size"].tolist(), g["odds"].tolist()
            some = [i for i in range(len(g)) if 1e-9 <= odds[i] <= 1 - 1e-9]
            rng.shuffle(some)
            some.sort(key=lambda i: -size[i])  # large items first, so that the one that stays fractional is likely a small one
            out, place, p = pivotal([size[i] for i in some], [odds[i] for i in some], rng)
            taken: list[int | None] = [int(o > 0.5) for o in odds]
            for i, x in zip(some, out, strict=True):
                taken[i] = x
            if place is not None:
                g.loc[some[place], "odds"] = p
                if last:
                    taken[some[place]] = int(rng.random() < p)
            return g.assign(taken=pd.array(taken, "Int32"))

        return run

    done, open_, shards = [], rated, level0
    while True:
        step = open_.groupBy("source", "shard").applyInPandas(rounds(shards == 1), shape)
        if shards == 1:
            done.append(step.where("taken is not null"))
            break
        step = stored(step)  # read by the result and by the next level
        done.append(step.where("taken is not null"))
        shards = -(-shards // FAN_IN)
        open_ = step.where("taken is null").select("id", "source", "size", "sure", "odds", F.pmod("shard", F.lit(shards)).cast("int").alias("shard"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("id", "source", "size", (F.col("sure") + F.col("taken")).alias("copies")).where("copies > 0")


def spark_empty(df: DataFrame, kind: str) -> DataFrame:
    """No item at all."""
    return df.sparkSession.createDataFrame([], f"id {kind}, source string, size int, copies int")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, items, tokens, most_repeats) of a mix, a row for each target; targets relative to their sum."""
    got = mixed.groupBy("source").agg(F.count("*").alias("items"), F.sum(F.col("size").cast("long") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"))
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["items", "tokens", "most_repeats"])
    whole = rows.agg(F.sum("tokens").alias("all_tokens"))
    return rows.join(F.broadcast(whole)).select("source", "target_share", (F.col("tokens") / F.nullif("all_tokens", F.lit(0))).alias("actual_share"), "items", "tokens", "most_repeats")


def _documents(spark: SparkSession, sf_dir: str, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    wanted = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").join(small(targets.select("source")), "source", "left_semi")
    return wanted.select("doc_id", "source", count_tokens(F.col("text"), tokenizer).alias("tokens")), targets


def p9_mix(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents of the mix and how often each is taken, sizes in tokens of the public tokenizer."""
    docs, targets = _documents(spark, sf_dir, tokenizer)
    return copies(docs, "doc_id", "source", "tokens", targets).withColumnsRenamed({"id": "doc_id", "size": "tokens"})


def p9_shares(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The shares that the mix reaches, by source."""
    docs, targets = _documents(spark, sf_dir, tokenizer)
    return shares(copies(docs, "doc_id", "source", "tokens", targets), targets)


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix must keep, by source with a target: its share of the tokens but for an item of each source, no item repeated too often; sizes in words and signs."""
    docs, targets = _documents(spark, sf_dir, WORDS)
    mixed = stored(copies(docs, "doc_id", "source", "tokens", targets))
    largest = mixed.agg(F.max("size").alias("largest"))
    s = shares(mixed, targets).join(F.broadcast(largest))
    present = s.where("items > 0").agg(F.sum("target_share").alias("all_shares"), F.count("*").alias("sources"), F.sum("tokens").alias("all_tokens"))
    s = s.join(F.broadcast(present)).join(small(targets.select("source", "max_repeats")), "source")
    near = F.abs(F.col("tokens") - F.col("target_share") / F.col("all_shares") * F.col("all_tokens")) <= F.col("largest") * F.col("sources")
    return s.where("items > 0").select("source", near.alias("reached"), (F.col("most_repeats") <= F.coalesce("max_repeats", F.lit(1))).alias("capped"))


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept": p9_kept}
SQL = {"p9_kept": "select source, true as reached, true as capped from mix_targets where target_share > 0 and source in (select source from documents where text is not null)"}
