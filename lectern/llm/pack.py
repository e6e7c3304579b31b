"""Texts combined into containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.split import _limit
from lectern.llm.tokens import TOKENIZER, WORDS, count_tokens

#: Items that one task packs, on average; thousands of containers, so that the last, part-filled one hardly counts.
SHARD_ITEMS = 20_000


class TightestFit:
    """Open containers by remaining capacity: a segment tree of counts over 0..capacity, and a stack of containers at each leaf."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, leaf: int, by: int) -> None:
        i, count = leaf + self.size, self.count
        while i:
            count[i] += by
            i >>= 1

    def push(self, room: int, container: int) -> None:
        self.at[room].append(container)
        self._add(room, 1)

    def pop(self, need: int) -> tuple[int, int] | None:
        """The container with the least room of at least ``need``, and its room; taken out of the tree. None if no open container has it."""
        count, size = self.count, self.size
        i = need + size
        if not count[i]:
            while True:  # up to the first ancestor that has a filled right sibling
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < size:  # down to its leftmost filled leaf
                i <<= 1
                if not count[i]:
                    i += 1
        room = i - size
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, numbered from 0; items must fit a container. Larger items first, of equals the earlier; items of size 0 are packed too."""
    out, tree, bins = np.zeros(len(sizes), np.int64), TightestFit(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        found = tree.pop(s)
        if found is None:
            room, c = capacity, bins
            bins += 1
        else:
            room, c = found
        out[i] = c
        tree.push(room - s, c)
    return out


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, part_no, parts, container, size): each item in one container; sizes in a container never exceed the capacity.

    An item larger than the capacity is split: its full parts fill containers of their own and its rest is packed like any item. Items are
    spread over shards by a hash of their id, so no shard grows with the data and no source or length is together; each shard is packed
    by itself in n log n. A shard has thousands of containers, of which only the last is part-filled by chance. A null id or size and a size below 1
    is left out (there is nothing to pack); rows with the same id are one item (the largest size); an empty table gives an empty result. Columns besides the two named aren't read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    items = df.select(F.col(id_col).alias("id"), F.col(size_col).cast("int").alias("size")).where("id is not null and size > 0").groupBy("id").agg(F.max("size").alias("size"))
    shards = max(1, round(df.select(id_col).count() / SHARD_ITEMS))
    full = F.floor((F.col("size") - 1) / capacity).cast("int")
    parts = items.select("id", "size", full.alias("full"), (F.pmod(F.xxhash64("id"), F.lit(shards))).cast("int").alias("shard"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        rest = g["size"].to_numpy() - g["full"].to_numpy() * capacity
        bins = best_fit_decreasing(rest, capacity)
        last = pd.DataFrame({"id": g["id"], "part_no": g["full"] + 1, "parts": g["full"] + 1, "bin": bins, "size": rest})
        over = g[g["full"] > 0]
        times = over["full"].to_numpy()
        first = int(bins.max()) + 1 if len(bins) else 0
        own = pd.DataFrame({
            "id": over["id"].repeat(times), "part_no": np.concatenate([np.arange(1, n + 1) for n in times]) if len(times) else np.zeros(0, int),
            "parts": (over["full"] + 1).repeat(times), "bin": first + np.arange(times.sum()), "size": capacity,
        })
        out = pd.concat([last, own], ignore_index=True)
        out["container"] = (np.int64(key[0]) << 32) + out["bin"]
        return out[["id", "part_no", "parts", "container", "size"]]

    return parts.groupBy("shard").applyInPandas(run, f"id {kind}, part_no int, parts int, container bigint, size int")


def p8_packed(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document in containers of the ``pack`` capacity, sizes in tokens of the public tokenizer."""
    capacity, _ = _limit(spark, sf_dir, "pack")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", count_tokens(F.col("text"), tokenizer).alias("tokens"))
    return pack(docs, "doc_id", "tokens", capacity).withColumnsRenamed({"id": "doc_id", "size": "tokens"})


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packing must keep: every document with all its tokens, as whole as its size allows, in containers that aren't overfull; sizes in words and signs."""
    capacity, _ = _limit(spark, sf_dir, "pack")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", count_tokens(F.col("text"), WORDS).alias("tokens"))
    packed = pack(docs, "doc_id", "tokens", capacity)
    held = packed.groupBy("container").agg(F.sum("size").alias("held"))
    each = packed.join(held, "container").groupBy(F.col("id").alias("doc_id"))
    return each.agg(F.sum("size").cast("long").alias("tokens"), F.count("*").alias("parts"), F.bool_and(F.col("held") <= capacity).alias("fits"))


QUERIES = {"p8_packed": p8_packed, "p8_kept": p8_kept}
SQL = {
    "p8_kept": """
with d as (select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\p{Z}\\x09-\\x0d\\x1c-\\x1f\\x85]')) as n from documents), c as (select max_tokens as cap from size_limits where purpose = 'pack')
select doc_id, cast(n as bigint) as tokens, cast(ceil(n / cap) as bigint) as parts, true as fits from d, c where n > 0
""",
}
