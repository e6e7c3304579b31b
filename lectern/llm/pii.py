"""Personal information in free text: found by a conditional random field, replaced by typed placeholders."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.chars import aligned, canonical
from lectern.llm.crf import Crf
from lectern.llm.pii_table import ARABIC_GIVEN, GIVEN, ID_WORDS, KINDS, LABELS, TOKEN, Writer
from lectern.sources.tables import latest

#: Pages whose lines without items stand around the marked ones in training, at most, and marked snippets of pages written.
SAMPLE_PAGES, TRAIN_PAGES = 1_500, 11_000
_DIGITS = re.compile(r"\d")
_ITEM = re.compile(
    r"@(?!nightly)|\(at\)|\[at\]|mailto|\+\s?\d|\(\d{3}\)|\d{3}[-/. ]\d{3}|\d{2}\.\d{2}\.\d{2}\.\d{2}|\b0\d{9,}|P\.\s?O\.|Postfach|ص\.ب|\bApt\b|\bFlat\b|\b(?:Road|Street|Lane|Ave|Court|Row)\b|str\. \d|weg \d|gasse \d|"
    r"\b(?:rue|impasse|avenue|bd\.|Calle|C/|Avda|Plaza|Travessa|Rua|Av\.|Largo)\b|شارع|طريق|زقاق|\b(?:Mx|Dr|Prof|Dipl)\b\.?|"
    + "|".join(re.escape(w.rstrip(":")) for w in ID_WORDS)
    + r"|\bCV\b|Vitae"
)
_GIVEN = frozenset((*GIVEN, *ARABIC_GIVEN))
_PROJECT = re.compile(r"(?:project|projekt|projet|proyecto|projeto|مشروع)\s+[^\W\d_]+(?:-\w|\s+(?:II|North|Plus|\d))?", re.I)
_TITLE = re.compile(r"^(?P<job>[^,\d]{3,40}), (?P<org>[^,(]{3,40}) \(.*\d{4}.*")


def plain_lines(texts: list[str]) -> tuple[list[str], list[str], list[str], frozenset[str]]:
    """(jobs, organisations, lines, vocabulary) of a sample: what surely holds no item. A line counts if nothing of the form of an item is in it and, but
    for project names, all its words occur on several pages; a job and an organisation come from dated lines and are taken only if they occur several times.
    """
    pages = [canonical(t).split("\n") for t in texts]
    seen, small, top = Counter(), Counter(), Counter()
    for p in pages:
        top.update({w.lower() for line in [x for x in p if x.strip()][:3] for w in TOKEN.findall(line) if w.isalpha()})
        ws = {w for line in p for w in TOKEN.findall(line) if w.isalpha()}
        seen.update(w.lower() for w in ws)
        small.update(w for w in ws if w[0].islower() or not (w[0].isupper() or w[0].islower()))
    jobs, organisations, whole = Counter(), Counter(), Counter()
    for p in pages:
        for line in p:
            if m := _TITLE.match(line):
                jobs[m["job"].strip()] += 1
                organisations[m["org"].strip()] += 1
            if line.strip():
                whole[_DIGITS.sub("9", line.strip())] += 1
    jobs, organisations = [j for j, n in jobs.items() if n >= 3], [o for o, n in organisations.items() if n >= 3]
    often = {w for j in (*jobs, *organisations) for w in TOKEN.findall(j.lower())}
    lines = []
    orgs = set(organisations)
    for p in pages:
        filled = [k for k, line in enumerate(p) if line.strip()]
        edge = {*filled[:3], *filled[-2:]}  # where names and headers stand
        for k, line in enumerate(p):
            bare = line.strip()
            if not bare or _ITEM.search(bare) or not _GIVEN.isdisjoint(TOKEN.findall(bare)):
                continue
            parts = re.split(r", | - ", bare)
            if len(parts) > 1 and parts[1] in orgs and parts[0] not in jobs or k in edge and bare not in jobs and not bare.endswith(".") and whole[_DIGITS.sub("9", bare)] < 8:
                continue
            known = whole[_DIGITS.sub("9", bare)] >= 4 or all(
                seen[w.lower()] >= 4 and (w[:1].islower() or small[w.lower()] >= 2 or w.lower() in often or seen[w.lower()] >= max(12, 4 * top[w.lower()])) for w in TOKEN.findall(_PROJECT.sub("", bare)) if w.isalpha()
            )
            if known and len(re.findall(r"[^\W\d_]", bare)) > 2:
                lines.append(bare)
    vocabulary = Counter(w for line in lines for w in set(TOKEN.findall(_PROJECT.sub(" ", line).lower())))
    names = {w.lower() for w in _GIVEN}
    lower = {w for w, n in small.items() if n >= 3 and w not in names and 4 * top[w] <= seen[w]}  # small words anywhere, also beside items
    lower |= {w for w, n in seen.items() if n * 30 >= len(pages) and w not in names}  # titles of the documents
    return jobs, organisations, lines, frozenset(w for w, n in vocabulary.items() if n >= 2) | lower | frozenset(w for x in ID_WORDS for w in TOKEN.findall(x.lower()))


def fit(pages: DataFrame, text_col: str, id_col: str, sample_pages: int = SAMPLE_PAGES, train_pages: int = TRAIN_PAGES, seed: int = 7) -> Crf:
    """A model from the written table, among plain lines of the ``sample_pages`` texts with the least hash of their id."""
    rows = pages.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = rows.count()
    if n:
        h = F.xxhash64(id_col).bitwiseAND(F.lit(0xFFFFFFFF))
        near = rows.where(h <= int(min(1.0, 2 * sample_pages / n) * 0xFFFFFFFF))  # so that the sort stays as small at any size
        texts = [r.t for r in near.select(F.col(text_col).alias("t"), h.alias("h")).orderBy("h", "t").limit(sample_pages).collect()]
    else:
        texts = []
    return train(texts, train_pages, seed)


def train(texts: list[str], train_pages: int = TRAIN_PAGES, seed: int = 7, lines: list[str] | None = None) -> Crf:
    """The model for a sample of texts; lines: other sentences with items than those of the table."""
    jobs, organisations, plain, vocabulary = plain_lines(sorted(texts))
    random.Random(seed).shuffle(plain)
    w = Writer(seed, jobs, organisations, plain, lines)
    return Crf(LABELS, vocabulary).fit([w.page() for _ in range(train_pages)], seed=seed)


_AT = re.compile(r"@|\bat\b", re.I)


def _valid(kind: str, text: str) -> bool:
    """The exact check: an item of the kind can't lack this."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(_AT.search(text)) and len(text) >= 6
    if kind == "phone":
        return digits + len(re.findall(r"[lOoIS]", text)) >= 5
    if kind == "identity_number":
        return digits >= 4
    if kind == "person_name":
        return sum(c.isalpha() for c in text) >= 2 and digits * 3 <= len(text)
    return digits >= 1


def items(texts: list[str], crf: Crf) -> list[list[tuple[str, int, int]]]:
    """(kind, first character, character after the last) of the items of each text, in order. Offsets are of the canonical form of the text."""
    tokens = [list(TOKEN.finditer(t)) for t in texts]
    out = []
    for text, ms, path in zip(texts, tokens, crf.decode([[m.group() for m in ms] for ms in tokens]), strict=True):
        found, i = [], 0
        while i < len(path):
            label = LABELS[path[i]]
            if label == "O":
                i += 1
                continue
            j = i + 1
            while j < len(path) and LABELS[path[j]] == f"I-{label[2:]}":
                j += 1
            end = j
            while i < end and ms[i].group() in "\n,;|·،)":
                i += 1
            while end > i and ms[end - 1].group() in "\n,;|·،(>":
                end -= 1
            if end > i:
                a, b = ms[i].start(), ms[end - 1].end()
                if text[a - 1 : a] == "(" and text.count(")", a, b) > text.count("(", a, b):
                    a -= 1
                if _valid(label[2:], text[a:b]):
                    found.append((label[2:], a, b))
            i = j
        out.append(found)
    return out


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each item replaced by its placeholder; line breaks within an item stay."""
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], f"[{kind.upper()}]", "\n" * text.count("\n", a, b)]
        at = b
    return "".join(out) + text[at:]


def find(df: DataFrame, id_col: str, text_col: str, crf: Crf) -> DataFrame:
    """(id, kind, line_no, first_char, last_char) of every item; lines count from 1, characters from 0 in the canonical form of the text.

    No shuffle; each batch of texts is decoded where it is read, whole texts at once. Null and empty texts give no row, repeated rows repeated items, an empty table an
    empty result; columns besides the two named aren't read.
    """
    shared = df.sparkSession.sparkContext.broadcast(crf)  # bounded by the training table and the sample
    out = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("line_no", pa.int32()), ("first_char", pa.int32()), ("last_char", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                texts = [canonical(t) for t in b.column(1).to_pylist()]
                rows = [(i, kind, t.count("\n", 0, x) + 1, x, y - 1) for i, t, found in zip(b.column(0).to_pylist(), texts, items(texts, shared.value), strict=True) for kind, x, y in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, out, strict=True)], schema=out)

    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id bigint, kind string, line_no int, first_char int, last_char int")


def redact(df: DataFrame, id_col: str, text_col: str, crf: Crf) -> DataFrame:
    """(id, text) with typed placeholders for the items of each text; everything else stays as it is, look-alike characters too. As ``find`` otherwise; an empty text stays."""
    shared = df.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                raw = b.column(1).to_pylist()
                plain = [aligned(t) for t in raw]
                done = []
                for t, (_, offsets), found in zip(raw, plain, items([x for x, _ in plain], shared.value), strict=True):
                    done.append(redacted(t, found if offsets is None else [(k, offsets[x], offsets[y - 1] + 1) for k, x, y in found]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["id", "text"])

    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id bigint, text string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages on which an item of personal information begins, by kind."""
    pages = spark.read.parquet(f"{sf_dir}/cv_pages.parquet")
    return find(pages, "page_id", "text", fit(pages, "text", "page_id")).select(F.col("id").alias("page_id"), "line_no", "kind").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full texts of all profiles with placeholders; re-delivered and revised profiles once."""
    pages = spark.read.parquet(f"{sf_dir}/cv_pages.parquet")
    profiles = spark.read.parquet(f"{sf_dir}/profiles.parquet").groupBy("profile_id").agg(F.max_by("full_text", F.struct("revision", "ingested_at")).alias("full_text"))
    return redact(profiles, "profile_id", "full_text", fit(pages, "text", "page_id")).withColumnRenamed("id", "profile_id")


def p1_redacted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all pages with placeholders; re-delivered pages once."""
    pages = spark.read.parquet(f"{sf_dir}/cv_pages.parquet")
    once = latest(pages, "page_id", ["ingested_at"], ["text"])
    return redact(once, "page_id", "text", fit(pages, "text", "page_id")).withColumnRenamed("id", "page_id")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p1_redacted_pages": p1_redacted_pages}
SQL: dict[str, str] = {}
assert set(KINDS) == {x[2:] for x in LABELS if x != "O"}
