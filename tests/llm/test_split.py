import random

import numpy as np
import pytest

from lectern.llm.split import PARAGRAPH, SENTENCE, RangeMax, cut, split_texts, strengths
from lectern.llm.tokens import WORDS, n_tokens, token_starts


def sample(n, seed=0):
    r = random.Random(seed)
    parts = []
    for _ in range(n):
        parts.append(" ".join(r.choice(["word", "süß", "مرحبا", "a", "supercalifragilistic", "x9", "😀"]) for _ in range(r.randrange(1, 12))) + r.choice([". ", ", ", "\n", "\n\n", "! "]))
    return "".join(parts)


def test_range_max_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        v = rng.integers(0, 4, rng.integers(1, 70))
        index = RangeMax(v, 16)
        for a in range(len(v)):
            for b in range(a, min(len(v), a + 16)):
                best = v[a : b + 1].max()
                assert index.best(a, b) == max(i for i in range(a, b + 1) if v[i] == best)


@pytest.mark.parametrize("tokenizer", [WORDS, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "/opt/tokenizers/byte_bpe_50k.tiktoken"])
@pytest.mark.parametrize(("limit", "overlap"), [(64, 0), (64, 16), (16, 3), (200, 64)])
def test_round_trip(tokenizer, limit, overlap):
    for seed in range(4):
        text = sample(60, seed)
        pieces = cut(text, limit, overlap, tokenizer)
        at, joined = 0, ""
        for a, b, size in pieces:
            assert a <= at and size == n_tokens(text[a:b], tokenizer) <= limit
            joined += text[at:b]
            at = b
        assert joined == text
        if overlap and tokenizer == WORDS:
            for (a, b, _), (c, _, _) in zip(pieces, pieces[1:], strict=False):
                assert n_tokens(text[c:b], WORDS) == overlap


def test_natural_boundaries_come_first():
    text = ("one two three four. " * 6).strip() + "\n\n" + "five six seven eight. " * 6
    first = cut(text, 40, 0, WORDS)[0]
    assert text[: first[1]].endswith("\n\n")
    starts = token_starts(text, WORDS)
    s = strengths(text, starts)
    assert s.max() == PARAGRAPH and (s == SENTENCE).sum() > 5


def test_bad_limits():
    with pytest.raises(ValueError):
        cut("a b", 4, 4, WORDS)


def test_operator_edge_cases(spark):
    long = "w " * 5000
    df = spark.createDataFrame([(1, long, "t"), (1, long, "t"), (2, "short", "t"), (3, None, "t"), (4, "", "t"), (None, long, "t"), (5, "x" * 9000, "t")], "doc_id bigint, body string, text string")
    got = split_texts(df, "doc_id", "body", 100, None, WORDS).collect()
    assert sum(r.id == 1 for r in got) == 100 and {r.id for r in got} == {1, None}
    assert split_texts(df, "doc_id", "body", 100, 10).where("id = 5").count() > 1
    assert split_texts(df.limit(0), "doc_id", "body", 100, 10).count() == 0
