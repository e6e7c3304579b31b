"""Oversized texts cut into overlapping pieces at natural boundaries, by a sparse-table range maximum over boundary strengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.tokens import TOKENIZER, WORD_PATTERN, WORDS, count_tokens, n_tokens, token_starts

#: Strength of the cut before a token, by what stands between it and the token before: nothing, a blank, a clause, a sentence, a line, a paragraph.
NONE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_RULES = [
    (SPACE, re.compile(r"\s+")),
    (CLAUSE, re.compile(r"[,;:،؛)\]–—]\s+")),
    (SENTENCE, re.compile(r"[.!?؟。…][\"'»”)\]]*\s+")),
    (LINE, re.compile(r"(?<![^\S\n])[^\S\n]*\n\s*")),
    (PARAGRAPH, re.compile(r"(?<![^\S\n])[^\S\n]*\n[^\S\n]*\n\s*")),
]


def strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """Strength of a cut before each token. A cut counts at the end of the blank space or at its start, where a token carries the space before it."""
    by_char = np.zeros(len(text) + 1, np.int8)
    for s, p in _RULES:
        for m in p.finditer(text):
            blank = m.end() - len(m.group()) + len(m.group().rstrip())
            by_char[blank : m.end() + 1] = np.maximum(by_char[blank : m.end() + 1], s)
    return by_char[starts]


class RangeMax:
    """Sparse table: the rightmost position of the greatest value in any window of at most ``width`` places, in constant time."""

    def __init__(self, values: np.ndarray, width: int) -> None:
        self.n = len(values)
        key = values.astype(np.int64) * (self.n + 1) + np.arange(self.n)  # the greater key is stronger, then further right
        self.levels = [key]
        for k in range(max(1, min(width, self.n)).bit_length() - 1):
            last, step = self.levels[-1], 1 << k
            self.levels.append(np.maximum(last[: len(last) - step], last[step:]))

    def best(self, a: int, b: int) -> int:
        """Position of the greatest value in [a, b]."""
        k = (b - a + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[a], level[b - (1 << k) + 1]) % (self.n + 1))


def cut(text: str, max_tokens: int, overlap: int = 0, tokenizer: str = TOKENIZER) -> list[tuple[int, int, int]]:
    """Pieces of a text as (first character, character after the last, tokens); one piece if the text fits.

    From the start of a piece the strongest boundary is taken among those at least half a limit (and more than the overlap) away and within the
    limit, the rightmost of equals; the next piece starts ``overlap`` tokens before it. The pieces without their overlaps are the text.
    """
    if max_tokens - overlap < (1 if tokenizer == WORDS else 8):  # a character may have several tokens
        raise ValueError(f"an overlap of {overlap} doesn't fit pieces of {max_tokens} tokens")
    starts = token_starts(text, tokenizer)
    n = len(starts)
    if n <= max_tokens:
        return [(0, len(text), n)]
    at = np.concatenate([starts, [len(text)]])
    at[0] = 0
    whole = np.concatenate([[True], at[1:] > at[:-1]])  # no cut inside a character
    index = RangeMax(np.where(whole[:n], strengths(text, starts), -1) + 1, max_tokens)
    pieces, a = [], 0
    while True:
        room = max_tokens
        while True:
            if n - a <= room:
                b = n
            else:
                low = a + max(overlap + 1, room // 2)
                b = index.best(min(low, a + room), a + room)
            size = b - a if tokenizer == WORDS else n_tokens(text[at[a] : at[b]], tokenizer)
            if size <= max_tokens or room <= overlap + 2:
                break
            room -= max(1, size - max_tokens)  # a piece that starts or ends inside a word can have more tokens by itself
        pieces.append((int(at[a]), int(at[b]), size))
        if b == n:
            return pieces
        after, a = a + 1, max(a + 1, b - overlap)
        while not whole[a] and a > after:
            a -= 1
        while not whole[a]:
            a += 1


def split_texts(df: DataFrame, id_col: str, text_col: str, max_tokens: int, overlap: int | None = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece_no, pieces, first_char, last_char, n_tokens, text) of every text above the limit; pieces count from 1.

    Texts within the limit, null and empty texts give no row (a text of no more characters than the limit isn't even tokenized). A null overlap
    is none. There is no shuffle: each text is cut where it is read, in windows, so a very long text needs memory for its own tokens only.
    Repeated rows give repeated pieces, an empty table an empty result; columns besides the two named aren't read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    out = pa.schema([("id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("first_char", pa.int64()), ("last_char", pa.int64()), ("n_tokens", pa.int32()), ("text", pa.string())])
    overlap = overlap or 0
    large = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") > max_tokens // (1 if tokenizer == WORDS else 4))
    if tokenizer == WORDS:
        large = large.where(F.regexp_count("t", F.lit(WORD_PATTERN)) > max_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = cut(t, max_tokens, overlap, tokenizer)
                if len(found) > 1:
                    rows += [(i, k, len(found), x, y - 1, size, t[x:y]) for k, (x, y, size) in enumerate(found, 1)]
                if len(rows) > 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return large.mapInArrow(run, f"id {kind}, piece_no int, pieces int, first_char bigint, last_char bigint, n_tokens int, text string")


def _limit(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int | None]:
    row = spark.read.parquet(f"{sf_dir}/size_limits.parquet").where(F.col("purpose") == purpose).first()
    return row.max_tokens, row.overlap_tokens


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have to be cut: those with more words and signs than the limit."""
    limit, overlap = _limit(spark, sf_dir, "split")
    return split_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", limit, overlap, WORDS).where("piece_no = 1").select(F.col("id").alias("doc_id"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents above the limit, by the public tokenizer."""
    limit, overlap = _limit(spark, sf_dir, "split")
    return split_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", limit, overlap).withColumnRenamed("id", "doc_id")


def p10_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cutting must keep: the pieces of a document put together again without what they share, as a hash, and whether all are within the limit; sizes in words and signs."""
    limit, overlap = _limit(spark, sf_dir, "split")
    pieces = split_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text", limit, overlap, WORDS)
    own = F.struct("piece_no", "first_char", "last_char", "text")
    each = pieces.groupBy(F.col("id").alias("doc_id")).agg(F.array_sort(F.collect_list(own)).alias("p"), F.bool_and((F.col("n_tokens") <= limit) & (F.regexp_count("text", F.lit(WORD_PATTERN)) <= limit)).alias("within"))  # a document's pieces
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("t"))
    whole = F.aggregate("p", start, lambda acc, x: F.struct((x["last_char"] + 1).alias("at"), F.concat(acc["t"], F.substr(x["text"], (acc["at"] - x["first_char"] + 1).cast("int"))).alias("t")))
    return each.select("doc_id", F.md5(whole["t"]).alias("form"), "within")


QUERIES = {"p10_found": p10_found, "p10_pieces": p10_pieces, "p10_rejoined": p10_rejoined}
_LARGE = """documents
where len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\p{Z}\\x09-\\x0d\\x1c-\\x1f\\x85]')) > (select max_tokens from size_limits where purpose = 'split')"""
SQL = {"p10_found": f"select doc_id from {_LARGE}", "p10_rejoined": f"select doc_id, md5(text) as form, true as within from {_LARGE}"}
