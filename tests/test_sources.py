import io
import zipfile

from pyspark.sql import functions as F

from lectern.sources import documents as D
from lectern.sources import sessions as S
from lectern.sources.tables import latest


def archive(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return b.getvalue()


def docx(*lines, rows=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    t = "".join("<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr></w:tbl>" for r in rows)
    return archive(**{"word/document.xml": f"<w:document {w}><w:body>{p}{t}</w:body></w:document>"})


def test_archive_members():
    z = archive(**{"a.pdf": "1", "x/A.pdf": "2", "../evil.pdf": "3", "/abs.pdf": "4", ".hidden.pdf": "5", "__MACOSX/b.pdf": "6", "n.txt": "7", "d/c.docx": "8"})
    assert [n for n, _ in D.archive_members(z)] == ["a.pdf", "A_1.pdf", "c.docx"]
    assert D.archive_members(b"no zip") == [] and D.archive_members(None) == []


def test_expand_and_read(spark, tmp_path):
    (tmp_path / "one.docx").write_bytes(docx("Name", "Line", rows=[("a", "a", "b")]))
    (tmp_path / "b.zip").write_bytes(archive(**{"in.docx": docx("Inner")}))
    (tmp_path / "skip.txt").write_text("x")
    files = D.expand(D.read_files(spark, str(tmp_path)))
    assert sorted((r.name, r.container, r.kind) for r in files.collect()) == [("in.docx", "b.zip", "docx"), ("one.docx", None, "docx")]
    assert {r.name: r.text for r in D.docx_pages(files).collect()} == {"one.docx": "Name\nLine\na | b", "in.docx": "Inner"}
    assert D.docx_text(b"broken") == ""


def test_columns_of_words():
    left = [(10 + 20 * (i % 4), 25 + 20 * (i % 4), 12 * (i // 4), 12 * (i // 4) + 10, f"l{i}") for i in range(32)]
    right = [(300 + 20 * (i % 4), 315 + 20 * (i % 4), 12 * (i // 4), 12 * (i // 4) + 10, f"r{i}") for i in range(32)]
    assert [len(c) for c in D.columns_of_words(left + right, 500)] == [32, 32]
    assert D.columns_of_words(left + right, 500, rtl=True)[0][0][4].startswith("r")
    assert len(D.columns_of_words(left, 500)) == 1 and len(D.columns_of_words([], 500)) == 1


def test_sources_of_pages(spark, rows):
    df = spark.createDataFrame([("", "seen text", 80.0, 1), ("own text is longer", "short", 70.0, 0), (None, None, None, 0)], "t string, o string, c double, n int")
    assert rows(df.select(D.needs_ocr(F.col("t"), F.col("n")))) == [(True,), (True,), (True,)]
    assert [r[0].source for r in df.select(D.choose_source(F.col("t"), F.col("o"), F.col("c"))).collect()] == ["ocr", "ocr", "text"]
    long = "a layer of text that is long enough"
    cases = spark.createDataFrame([(0, long, long * 3, 90.04), (1, "thin", "what the picture says", 81.26), (2, "thin", " ", 12.0), (3, " ", "", 30.0), (4, None, None, None)], "k int, t string, o string, c double")
    chosen = lambda mode: [tuple(r[1]) for r in cases.select("k", D.choose_source(F.col("t"), F.col("o"), F.col("c"), mode)).orderBy("k").collect()]
    assert chosen("auto") == [(long, "text", None), ("what the picture says", "ocr", 81.3), ("thin", "text", None), ("", "ocr", 30.0), ("", "text", None)]
    assert chosen("force")[0] == (long * 3, "ocr", 90.0)
    seen = spark.createDataFrame([(1, "old", " x" * 30), (2, "old", "too short"), (3, "old", None)], "k int, t string, v string")
    assert [r[0][:3] for r in seen.orderBy("k").select(D.replace_rescued(F.col("t"), F.col("v"))).collect()] == ["x x", "old", "old"]
    readings = spark.createDataFrame([(1, "a", 10, 50.0, "A"), (1, "b", 20, 40.0, "B"), (1, "c", 8, 100.0, "C"), (2, "a", None, None, "")], "page int, variant string, words int, confidence double, text string")
    assert rows(D.best_variant(readings, ["page"]).select("page", "text")) == [(1, "B"), (2, "")]


def test_short_second_column_is_seen():
    left = [(10.0, 60.0, 10.0 * i, 10.0 * i + 8, f"l{i}") for i in range(60)]
    right = [(120.0, 170.0, 10.0 * i, 10.0 * i + 8, f"r{i}") for i in range(12)]
    assert len(D.columns_of_words(left + right, 200.0)) == 2


def test_limit_of_files_by_batch(spark):
    data = [(f"{k:02}.pdf", b"x", str(k), None, b) for b in ("one", "two") for k in range(5)]
    files = spark.createDataFrame(data, "name string, content binary, hash string, container string, upload string")
    assert D.expand(files, 3).count() <= 6 and {(r.upload, r["count"]) for r in D.expand(files, 3, "upload").groupBy("upload").count().collect()} == {("one", 3), ("two", 3)}
    pages = spark.createDataFrame([(1, p, "ocr", 50.0, "x" * 50) for p in range(40)], "d int, page int, source string, ocr_confidence double, text string")
    assert D.rescue_pages(pages, "d").count() == 6 and D.truncate_pages(pages, "d").count() == 30


def test_sessions(spark, rows, tmp_path):
    p = str(tmp_path / "s")
    S.save(spark.createDataFrame([("a", 1), ("b", 2)], "chat_id string, x int"), p)
    S.save(spark.createDataFrame([("b", 3)], "chat_id string, x int"), p)
    assert rows(S.load(spark, p, "a").select("x")) == [(1,)] and rows(S.load(spark, p, "b").select("x")) == [(3,)]
    t = spark.sql("select 'x' as chat_id, timestamp'2026-06-01 10:00:00' as last_seen_at union all select 'y', timestamp'2026-06-01 10:00:01' union all select 'z', null")
    assert rows(S.expired(t, "2026-06-01 12:00:01").select("chat_id")) == [("x",)]
    log = spark.range(200).select(F.lit(1).alias("k"), "id")
    assert S.retain(log, "k", ["id"]).agg(F.min("id"), F.count("*")).first() == (150, 50)
    assert S.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string"), ["n", "t"], "T") == "## T\n\n| n | t |\n|---|---|\n| 1 | a\\|b |\n| 2 | – |\n"


def test_latest(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 5, "d"), (2, None, None)], "k int, o int, v string")
    assert rows(latest(df, "k", ["o"], ["v"])) == [(1, "b"), (2, None)]
    assert rows(latest(df.limit(0), "k", ["o"], ["v"])) == []


def test_broadcast_only_what_is_small(spark):
    from lectern.sources.shared import small

    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(spark.range(10), 10)) and "broadcast" not in plan(small(spark.range(11), 10))


def test_one_bad_file_does_not_end_a_batch(spark, rows):
    files = spark.createDataFrame([("a.pdf", "pdf", b"one\x0ctwo"), ("b.pdf", "pdf", b"bad"), ("c.png", "image", b"x"), ("d.docx", "docx", b"not a zip"), ("e.pdf", "pdf", None)], "name string, kind string, content binary")

    def pdf(content):
        if content == b"bad":
            raise RuntimeError("broken")
        return [(t, "text", None) for t in content.decode().split("\x0c")]

    got = D.acquire(files, {"pdf": pdf})
    assert rows(got.where("error is null").select("name", "page", "text")) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    assert rows(got.where("error is not null").select("name", "error")) == [("b.pdf", "RuntimeError: broken"), ("c.png", "no reader for image"), ("d.docx", "no text"), ("e.pdf", "no text")]
    assert D.error_profiles(got).count() == 4 and D.error_profiles(got).first().reasons == ["UNREADABLE_FILE"]


def test_reports_are_small(spark):
    import pytest

    with pytest.raises(ValueError):
        S.markdown(spark.range(30), ["id"], "t", most=20)
