"""Queries that give texts back cover every table of their problem."""

import datetime

from lectern.llm import normal, pii
from tests.llm.test_pii import PLAIN

DAY = datetime.datetime(2026, 6, 1)


def _write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_canonical_pages_and_job_descriptions(spark, tmp_path):
    _write(spark, tmp_path, "cv_pages", [(1, "Ｓkills"), (1, "Ｓkills"), (2, None)], "page_id bigint, text string")
    _write(spark, tmp_path, "score_requests", [(1, "Рауroll", DAY), (1, "Рауroll", DAY), (2, None, DAY), (3, "", DAY)], "request_id bigint, jd_text string, ingested_at timestamp")
    got = sorted((r.origin, r.item_id, r.canonical, r.styled, r.lookalike) for r in normal.p5_canonical(spark, str(tmp_path)).collect())
    assert got == [("jd", 1, "Payroll", False, True), ("jd", 3, "", False, False), ("page", 1, "Skills", True, False)]


def test_every_page_is_redacted(spark, tmp_path, monkeypatch):
    crf = pii.train(["\n".join(PLAIN)] * 60, train_pages=900)
    monkeypatch.setattr(pii, "fit", lambda *a, **k: crf)
    mail = "E-mail: anna.stein@mail.example"
    _write(spark, tmp_path, "cv_pages", [(1, mail, DAY), (1, mail, DAY), (2, "Skills", DAY), (3, "", DAY), (4, None, DAY)], "page_id bigint, text string, ingested_at timestamp")
    assert sorted(tuple(r) for r in pii.QUERIES["p1_redacted_pages"](spark, str(tmp_path)).collect()) == [(1, "E-mail: [EMAIL]"), (2, "Skills"), (3, "")]
