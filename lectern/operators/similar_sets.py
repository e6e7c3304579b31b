"""Near-duplicate texts: exact set-similarity join on word shingles by prefix filter, over classes of equal texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.shared import small, stored

#: Places of the table of shingle frequencies that orders the shingles; any order gives the same result, rare ones first the fewest pairs. Texts that are looked at together.
PLACES, TEXTS = 1 << 20, 1_000
#: Shingles that two texts have to share at the head of their order before their whole sets are compared.
HEADS = 8
#: Parts in which the tasks' tables are summed up before the driver gets them.
SUMS = 8


def words(text):
    """The words of a text in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def shingles(hashes: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the word hashes of texts, ordered: distinct hashes of the runs of k words; a shorter text is one shingle, one without words none."""
    ends = hashes.offsets.to_numpy().astype(np.int64)
    h, size = hashes.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64), np.diff(ends)
    start, row = ends[:-1] - ends[0], np.repeat(np.arange(len(size)), size)
    mixed = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(mixed)]
    at = np.arange(len(mixed))
    whole = at + k <= (start + size)[row[: len(mixed)]]
    rows, out = [row[: len(mixed)][whole]], [mixed[whole]]
    for r in np.flatnonzero((size > 0) & (size < k)):
        x = int(size[r])
        for w in h[start[r] : start[r] + size[r]].tolist():
            x = (x * 0x9E3779B97F4A7C15 + w + 1) & (1 << 64) - 1
        rows.append(np.array([r]))
        out.append(np.array([x], np.uint64))
    row, x = np.concatenate(rows), np.concatenate(out)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1])
    return row[new], x[new]


def _place(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(PLACES - 1)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield b.slice(i, TEXTS)


def _hashed(texts: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(id, h, key) of the texts, written once, h and key being hashes of their words; and how many texts have a shingle, by its place among PLACES."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.binary()), ("key", pa.int64()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, np.int64)
        for b in _parts(batches):
            n += np.bincount(_place(shingles(b.column(3), k)[1]), minlength=PLACES)
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(schema[i].type) for i in range(3)), pa.nulls(b.num_rows, pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, schema[i].type) for i in range(3)), pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PLACES, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())], names=["counts"])

    both = stored(texts.mapInArrow(run, "id bigint, h binary, key bigint, counts binary"))
    sums = both.where("counts is not null").select("counts").repartition(SUMS).mapInArrow(add, "counts binary").toLocalIterator()
    counts = sum((np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64) for r in sums), np.zeros(PLACES, np.int64))  # one table of PLACES numbers at a time
    return both.where("counts is null").drop("counts"), counts


def _prefixes(texts: DataFrame, counts: np.ndarray, threshold: float, k: int) -> DataFrame:
    """(x, key, n, pos): of the n shingles of each text, those at the first size - ceil(t * size) + HEADS positions of the order."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)  # PLACES numbers
    schema = pa.schema([("x", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            row, x = shingles(b.column(1), k)
            order = np.lexsort((x, shared.value[_place(x)], row))
            row, x = row[order], x[order]
            size = np.bincount(row, minlength=b.num_rows)
            pos = np.arange(len(row)) - (np.cumsum(size) - size)[row] + 1
            n = size[row]
            first = pos <= n - np.ceil(n * threshold - 1e-6) + HEADS
            yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)), pa.array(b.column(0).to_numpy()[row[first]]), pa.array(n[first].astype(np.int32)), pa.array(pos[first].astype(np.int32))], schema=schema)

    return texts.select("key", F.col("x").alias("h")).mapInArrow(run, "x bigint, key bigint, n int, pos int")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, h, key, s): the shingles of texts (id, h, key, x)."""
    schema = pa.schema([("id", pa.int64()), ("h", pa.binary()), ("key", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            row, x = shingles(b.column(3), k)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(schema[i].type) for i in range(3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.view(np.int64)))], schema=schema)

    return texts.mapInArrow(run, "id bigint, h binary, key bigint, s array<bigint>")


def similar_texts(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """(id, class_id, copies, links): the class of equal texts of each row, and to how many other classes its text is similar.

    Texts are equal if their words are (case and punctuation aside). Shingles are ordered by how many texts have them, counted by places, and only the head of each text's order is joined on.
    Two texts of that similarity share t / (1 + t) of their sizes together, at least; the first HEADS of what they share stand, in either, before so many others less HEADS. So texts that share
    fewer in these heads are left, and the others are verified on their whole sets, for which they are read once more. Frames of unknown size are joined by merging: shingles are many times
    what Spark estimates for their texts. Null ids and null texts drop out; a text without words is a class of its own kind, linked to nothing; an empty table gives an empty result.
    """
    given = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def worded(texts: DataFrame) -> DataFrame:
        said = F.array_join("w", " ")
        return texts.select("id", words(F.col("t")).alias("w")).select("id", F.unhex(F.sha2(said, 256)).alias("h"), F.xxhash64(said).alias("key"), _hashes(F.col("w")).alias("x"))

    texts = worded(given)
    rows, counts = _hashed(texts, k)
    classes = rows.groupBy("h", "key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    prefix = _prefixes(texts, counts, threshold, k).repartition("x").dropDuplicates(["x", "key"])  # copies of a text are one
    a, b = prefix.alias("a"), prefix.alias("b")
    least = F.ceil(threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - F.lit(1e-6))
    sized = (F.col("a.n") >= threshold * F.col("b.n")) & (F.col("b.n") >= threshold * F.col("a.n"))
    heads = (F.col("a.pos") <= F.col("a.n") - least + HEADS) & (F.col("b.pos") <= F.col("b.n") - least + HEADS)
    between = F.least("a.pos", "b.pos") + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= least  # else too little stands before and behind this one
    met = a.join(b.hint("merge"), (F.col("a.x") == F.col("b.x")) & (F.col("a.key") < F.col("b.key")) & sized & heads & between)
    shared = met.groupBy(F.col("a.key").alias("ka"), F.col("b.key").alias("kb")).agg(F.count("*").alias("n"), F.first(least).alias("least"))
    pairs = stored(shared.where(F.col("n") >= F.least(F.col("least"), F.lit(HEADS))).select("ka", "kb"))
    asked = stored(classes.join(pairs.select(F.explode(F.array("ka", "kb")).alias("key")).distinct().hint("merge"), "key", "left_semi").select("key", "h", F.col("class_id").alias("id")))
    ids = asked.select("id").distinct()
    few = small(ids)
    read = worded(given.join(few if few is not ids else few.hint("merge"), "id", "left_semi"))
    sets = stored(_sets(read, k).join(asked.hint("merge"), ["id", "h", "key"], "left_semi").dropDuplicates(["id", "h"]).select("id", "key", "s"))
    both = pairs.join(sets.select(F.col("key").alias("ka"), F.col("id").alias("i"), F.col("s").alias("si")).hint("merge"), "ka").join(sets.select(F.col("key").alias("kb"), F.col("id").alias("j"), F.col("s").alias("sj")).hint("merge"), "kb").where("i <> j")
    common = F.size(F.array_intersect("si", "sj"))
    linked = both.where(common >= threshold * (F.size("si") + F.size("sj") - common)).select("i", "j")
    links = linked.select(F.explode(F.array("i", "j")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    of = rows.select("id", "h").join(classes.drop("key").hint("merge"), "h").join(links.hint("merge"), "class_id", "left")
    return of.select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
