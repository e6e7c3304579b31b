"""Files as rows: upload expansion with archives, text of word-processor files, pages, source selection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import file_kind

#: Files of one batch, members of one archive, pages of one document: limits that belong to the operators (a prefix of the batch is the feature).
MAX_FILES, MAX_MEMBERS, MAX_PAGES = 300, 500, 30
_SUPPORTED = re.compile(r"\.(pdf|docx|png|jpe?g|tiff?|bmp|webp)$", re.I)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, hash, kind, container) of all files under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"^.*[/\\]", "")
    return f.select(name.alias("name"), "content", F.sha2("content", 256).alias("hash"), file_kind(name).alias("kind"), F.lit(None).cast("string").alias("container"))


def archive_members(content: bytes | None, most: int = MAX_MEMBERS) -> list[tuple[str, bytes]]:
    """Supported members of a ZIP, by safe base names; none of a broken archive. Absolute paths, parents, hidden files and system folders are left out; equal names get a number."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content or b""))
    except (zipfile.BadZipFile, ValueError):
        return []
    out, taken = [], set()
    for m in z.infolist():
        parts = re.split(r"[/\\]", m.filename)
        base = parts[-1]
        if m.is_dir() or not base or ".." in parts or m.filename[:1] in "/\\" or re.match("^[A-Za-z]:", m.filename) or base.startswith(".") or "__MACOSX" in parts or not _SUPPORTED.search(base):
            continue
        if len(out) >= most:
            break
        stem, dot, ext = base.rpartition(".")
        k, name = 1, base
        while name.lower() in taken:
            name, k = f"{stem}_{k}{dot}{ext}", k + 1
        taken.add(name.lower())
        try:
            out.append((name, z.read(m)))
        except (zipfile.BadZipFile, RuntimeError, OSError):
            continue
    return out


def expand(files: DataFrame, most: int = MAX_FILES, batch: str | None = None) -> DataFrame:
    """(name, content, hash, kind, container) of the supported files, archives replaced by their members; the first ``most`` by container and name of each batch.

    batch: the column that says which upload a file came with (a string, kept in the result); without one all files are one upload.
    """
    files = files.withColumn("_batch", F.col(batch) if batch else F.lit(None).cast("string"))
    shape = "name string, content binary, hash string, container string, _batch string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = [(n, c, hashlib.sha256(c).hexdigest(), z, u) for z, content, u in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) for n, c in archive_members(content)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()), strict=True)], names=["name", "content", "hash", "container", "_batch"])

    zips = F.lower("name").endswith(".zip")
    inside = files.where(zips).select("name", "content", "_batch").mapInArrow(run, shape)
    every = files.where(~zips).select("name", "content", "hash", "container", "_batch").unionByName(inside).withColumn("kind", file_kind(F.col("name"))).where("kind <> 'unsupported'")
    # Contents stay where they are: keys are cut by batch, rank by rank, and those kept are joined.
    first = Window.partitionBy("_batch").orderBy(F.asc_nulls_first("container"), "name", "hash")
    keys = every.select("_batch", "container", "name", "hash").distinct().withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most).select(F.col("_batch").alias("kb"), F.col("container").alias("kc"), F.col("name").alias("kn"), F.col("hash").alias("kh"))
    kept = every.join(keys, F.col("_batch").eqNullSafe(F.col("kb")) & F.col("container").eqNullSafe(F.col("kc")) & (F.col("name") == F.col("kn")) & (F.col("hash") == F.col("kh")), "left_semi")
    return kept.withColumnRenamed("_batch", batch) if batch else kept.drop("_batch")


def docx_text(content: bytes | None) -> str:
    """Paragraphs, then table rows with their cells joined by bars, a merged cell once; empty for a file that can't be read."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content or b"")).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
        return ""
    body = root.find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines = [text(p) for p in (body if body is not None else root).findall(f"{_W}p")]
    for row in root.iter(f"{_W}tr"):
        cells = [text(c).strip() for c in row.findall(f"{_W}tc")]
        lines.append(" | ".join(c for i, c in enumerate(cells) if c and (i == 0 or c != cells[i - 1])))
    return "\n".join(x for x in lines if x.strip())


def docx_pages(files: DataFrame) -> DataFrame:
    """(name, page, text, source, ocr_confidence) of word-processor files: one page each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([docx_text(c) for c in b.column(1).to_pylist()], pa.string())], names=["name", "text"])

    pages = files.where("kind = 'docx'").select("name", "content").mapInArrow(run, "name string, text string")
    return pages.select("name", F.lit(1).alias("page"), "text", F.lit("text").alias("source"), F.lit(None).cast("double").alias("ocr_confidence"))


def columns_of_words(words: list[tuple[float, float, float, float, str]], width: float, rtl: bool = False) -> list[list[tuple]]:
    """Words (x0, x1, top, bottom, text) of a page as one or two columns: split at the widest gap of at least 16 points inside 15-85 % of the width, if there are 40 words,
    each side has 12 % of them, at most 10 % straddle it and the sides overlap by 35 % of the shorter one's height. Right-to-left pages are read from the right."""
    one = [sorted(words, key=lambda w: (round(w[2]), w[0]))]
    if len(words) < 40:
        return one
    best, at = 0.0, None
    edges = sorted({w[1] for w in words} | {0.15 * width})
    starts = sorted(w[0] for w in words)
    for e in edges:
        nxt = next((s for s in starts if s > e), None)
        mid = (e + nxt) / 2 if nxt is not None else None
        if mid is None or not 0.15 * width <= mid <= 0.85 * width:
            continue
        straddle = sum(w[0] < mid < w[1] for w in words)
        right = [w for w in words if w[0] >= mid]
        if straddle <= 0.1 * len(words) and right:
            gap = min(w[0] for w in right) - max((w[1] for w in words if w[1] <= mid), default=0)
            if gap >= 16 and gap > best:
                best, at = gap, mid
    if at is None:
        return one
    left, right = [w for w in words if (w[0] + w[1]) / 2 < at], [w for w in words if (w[0] + w[1]) / 2 >= at]
    overlap = min(max(w[3] for w in left), max(w[3] for w in right)) - max(min(w[2] for w in left), min(w[2] for w in right)) if left and right else 0
    shorter = min(max(w[3] for w in s) - min(w[2] for w in s) for s in (left, right)) if left and right else 0
    if min(len(left), len(right)) < 0.12 * len(words) or shorter <= 0 or overlap < 0.35 * shorter:
        return one
    sides = [sorted(s, key=lambda w: (round(w[2]), w[0])) for s in (left, right)]
    return sides[::-1] if rtl else sides


def needs_ocr(text: Column, images: Column, mode: str = "auto", least: int = 20) -> Column:
    """Whether a page is to be read from its picture: always, never, or where it has little text or only pictures."""
    if mode in ("force", "off"):
        return F.lit(mode == "force")
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return (n < least) | (n < 15) & (images > 0)


def choose_source(text: Column, ocr: Column, confidence: Column, mode: str = "auto", least: int = 20) -> Column:
    """(text, source, ocr_confidence): the recognised text where there is any and the page's own is too short or reading is forced; else the page's own.

    A page that has no text of its own and was read in vain (ocr isn't null) stays a scan with an empty text.
    """
    own, seen = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(ocr, F.lit("")))
    one = lambda t, s, c: F.struct(t.alias("text"), F.lit(s).alias("source"), c.cast("double").alias("ocr_confidence"))
    thin = F.lit(mode == "force") | (F.length(own) < least)
    return F.when((seen != "") & thin, one(seen, "ocr", F.round(confidence, 1))).when((own != "") | ocr.isNull(), one(own, "text", F.lit(None))).otherwise(one(own, "ocr", F.round(confidence, 1)))


def replace_rescued(text: Column, transcription: Column, least: int = 40) -> Column:
    """The text of a page that a stronger reader saw: its transcription, if that has at least so many characters."""
    return F.when(F.length(F.trim(transcription)) >= least, F.trim(transcription)).otherwise(text)


def best_variant(readings: DataFrame, key: list[str]) -> DataFrame:
    """Of several readings of a page (words, confidence, text), the one with the most words times confidence; ties go to the variant that comes first by name."""
    score = F.coalesce(F.col("words") * F.col("confidence") / 100, F.lit(0.0))
    best = F.min_by(F.struct("variant", "text", "confidence"), F.struct((-score).alias("s"), F.col("variant")))
    return readings.groupBy(*key).agg(best.alias("x")).select(*key, "x.*")


def rescue_pages(pages: DataFrame, doc: str, most: int = 6) -> DataFrame:
    """The first pages of each document that a stronger reader should see: scans of low confidence or with hardly any text."""
    need = pages.where("source = 'ocr' and (ocr_confidence < 60 or length(trim(text)) < 20)")
    return need.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy("page"))).where(F.col("_k") <= most).drop("_k")


def truncate_pages(pages: DataFrame, doc: str, most: int = MAX_PAGES) -> DataFrame:
    """The first pages of each document."""
    return pages.withColumn("_k", F.row_number().over(Window.partitionBy(doc).orderBy("page"))).where(F.col("_k") <= most).drop("_k")


_READ = "name string, page int, text string, source string, ocr_confidence double, error string"
_READ_ARROW = pa.schema([("name", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("source", pa.string()), ("ocr_confidence", pa.float64()), ("error", pa.string())])


def acquire(files: DataFrame, readers: dict[str, Callable[[bytes], list[tuple[str, str, float | None]]]] | None = None) -> DataFrame:
    """(name, page, text, source, ocr_confidence, error) of files of all kinds: a row for each page, or one row with an error for a file that can't be read, so that the batch goes on.

    readers: by kind (pdf, image, docx), a function from the content to (text, source, confidence) of its pages; word-processor files have one already. A kind without a reader, an
    empty content and whatever a reader raises become errors.
    """
    by_kind = {"docx": lambda content: [(docx_text(content), "text", None)], **(readers or {})}

    def one(name: str, kind: str, content: bytes | None) -> list[tuple]:
        if kind not in by_kind:
            return [(name, None, None, None, None, f"no reader for {kind}")]
        try:
            pages = by_kind[kind](content or b"")
        except Exception as e:  # noqa: BLE001  # a reader may raise anything, and a file must not end the batch
            return [(name, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
        if not any(t.strip() for t, _, _ in pages):
            return [(name, None, None, None, None, "no text")]
        return [(name, k, t, s, c, None) for k, (t, s, c) in enumerate(pages, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = one(*row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ_ARROW, strict=True)], schema=_READ_ARROW)

    return files.select("name", "kind", "content").mapInArrow(run, _READ)


def error_profiles(acquired: DataFrame) -> DataFrame:
    """(file, status, reasons, error) for the files that couldn't be read: profiles to be looked at, without content."""
    return acquired.where("error is not null").select(F.col("name").alias("file"), F.lit("NEEDS_REVIEW").alias("status"), F.array(F.lit("UNREADABLE_FILE")).alias("reasons"), "error")
