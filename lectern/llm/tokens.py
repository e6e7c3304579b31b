"""Sizes in tokens of a public tokenizer, and token boundaries as character offsets."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default vocabulary file; every operator takes another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Name of the plain tokenizer: a longest run of letters and digits, or any other single character that isn't blank.
WORDS = "words"
# Fixed value: the pre-tokenizer of the byte-level vocabularies.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
#: The same tokens for Spark's regular expressions.
WORD_PATTERN = r"(?U)[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


@cache
def encoding(path: str):
    """The byte-level tokenizer of a vocabulary file, once in a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text; null for a null text."""
    if tokenizer == WORDS:
        return F.regexp_count(text, F.lit(WORD_PATTERN))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(tokenizer)
        for s in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="Int32")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "int")(text)


def token_starts(text: str, tokenizer: str = TOKENIZER) -> np.ndarray:
    """Character offset at which each token starts; a token that starts inside a character starts with that character."""
    if tokenizer == WORDS:
        return np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64)
    enc = encoding(tokenizer)
    sizes = np.fromiter(map(len, enc.decode_tokens_bytes(enc.encode_ordinary(text))), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    if text.isascii():
        return starts
    raw = np.frombuffer(text.encode(), np.uint8)
    return (np.cumsum((raw & 0xC0) != 0x80) - 1)[starts]


def n_tokens(text: str, tokenizer: str = TOKENIZER) -> int:
    """Tokens of one text."""
    return sum(1 for _ in _WORD.finditer(text)) if tokenizer == WORDS else len(encoding(tokenizer).encode_ordinary(text))
