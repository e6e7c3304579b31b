"""Exact nearest neighbours of a query set among all rows, in blocks of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in one block of queries, and in one block of rows.
QUERY_BLOCK, ROW_BLOCK = 512, 4_096


def _blocks(df: DataFrame, id_col: str, vec_col: str, size: int, name: str) -> DataFrame:
    n = max(1, -(-df.count() // size))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias("k")).agg(F.collect_list(F.struct(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))).alias(name)).drop("k")  # about a block each


def cosine_top_k(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query, neighbour, cosine, place) for each query: its k nearest rows by cosine, itself left out; ties go to the smaller id.

    Both sides are packed into blocks by a hash of the id; every pair of blocks is one multiplication of matrices that leaves k rows a query, and a window over those gives the
    result. Vectors with another number of values than most queries have (the greater number, where two are as frequent) and vectors of length 0 have cosine 0 with all; nulls in a vector count as 0. Null ids and null vectors drop out; repeated rows repeat; empty tables give an empty result.
    """
    sizes = queries.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("size")).count()
    width = sizes.agg(F.max(F.struct("count", "size"))["size"].alias("w")).first().w or 0
    out = pa.schema([("query", pa.int64()), ("neighbour", pa.int64()), ("cosine", pa.float64())])

    def matrix(items: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        m = np.array([[0.0 if y is None else y for y in x["v"]] if len(x["v"]) == width else [0.0] * width for x in items], np.float64).reshape(len(items), width)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.array([x["i"] for x in items]), np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, r in zip(b.column(0), b.column(1), strict=True):
                (qi, qm), (ri, rm) = matrix(q.as_py()), matrix(r.as_py())
                score = np.round(qm @ rm.T, 12)
                score[qi[:, None] == ri[None, :]] = -2
                # The k-th score of each query bounds what stays; only that is sorted, ties by id.
                bound = -np.partition(-score, k - 1, axis=1)[:, k - 1] if score.shape[1] > k else np.full(len(qi), -1.5)
                at, to = np.nonzero((score >= bound[:, None]) & (score > -2))
                order = np.lexsort((ri[to], -score[at, to], at))
                at, to = at[order], to[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, to = at[place < k], to[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ri[to]), pa.array(score[at, to])], schema=out)

    pairs = _blocks(queries, id_col, vec_col, QUERY_BLOCK, "q").crossJoin(_blocks(rows, id_col, vec_col, ROW_BLOCK, "r"))  # a query set in blocks, one row for each pair of blocks
    near = pairs.mapInArrow(run, "query bigint, neighbour bigint, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
