import unicodedata

import pytest

from lectern.llm.chars import aligned, canonical
from lectern.llm.normal import canonical_text

CASES = [
    ("plain ASCII text", "plain ASCII text", ""), ("Ｓｋｉｌｌｓ １２", "Skills 12", "styled"), ("𝐄𝐝𝐮𝐜𝐚𝐭𝐢𝐨𝐧", "Education", "styled"), ("tender ﬁles oﬃce", "tender files office", "styled"), ("الآﻻت", "الآلات", "styled"),
    ("Re\u0301sume\u0301", "R\u00e9sum\u00e9", "combining"), ("Expe\xadrience Sum‌mary", "Experience Summary", "invisible"), ("a\xa0b　c d", "a b c d", "space"), ("Рауroll Εngineer Наldеn", "Payroll Engineer Halden", "lookalike"),
    ("کلیة المرفأ", "كلية المرفأ", "lookalike"), ("فارسی", "فارسی", ""), ("Русский, Українська, Ελληνικά", "Русский, Українська, Ελληνικά", ""), ("n.º 5 – “quoted” • 10 m² ٣٤", "n.º 5 – “quoted” • 10 m² ٣٤", ""), ("Türkçe straße", "Türkçe straße", ""), ("جدًا", "جدًا", ""),
    ("Укра﻿їнська", "Українська", "invisible"), ("", "", ""),
]


@pytest.mark.parametrize(("raw", "plain", "kind"), CASES)
def test_forms(raw, plain, kind):
    assert canonical(raw) == plain
    assert (canonical(raw) != raw) == bool(kind)


def test_operator_agrees_with_plain_python(spark):
    data = [(i, "\n".join([raw, "", raw + " x"]), True) for i, (raw, _, _) in enumerate(CASES)] + [(90, None, True), (None, "a", True), (91, "Ｘ" * 200_000, True), (92, "Ｘ", True), (92, "Ｘ", True)]
    df = spark.createDataFrame(data, "id bigint, t string, styled boolean")
    got = canonical_text(df, "id", "t", by_line=True).collect()
    for i, (raw, _, kind) in enumerate(CASES):
        lines = {r.line_no: r for r in got if r.id == i}
        assert [lines[k].canonical for k in (1, 2, 3)] == [canonical(x) for x in (raw, "", raw + " x")]
        assert [k for k in ("styled", "combining", "invisible", "space", "lookalike") if lines[1][k]] == ([kind] if kind else [])
    whole = {(r.id, r.canonical) for r in canonical_text(df, "id", "t").collect()}
    assert (91, "X" * 200_000) in whole and (None, "a") in whole and not any(i == 90 for i, _ in whole)
    changed = canonical_text(df, "id", "t", by_line=True, only_changed=True)
    assert {r.id for r in changed.collect()} == {i for i, c in enumerate(CASES) if c[2]} | {91, 92} and changed.where("id = 92").count() == 2
    assert canonical_text(df.limit(0), "id", "t").count() == 0


def test_offsets_lead_back():
    for raw, _, _ in CASES:
        plain, at = aligned("x " + raw + " y")
        if at is not None:
            assert len(at) == len(plain) + 1 and at == sorted(at)
            k = plain.index("y", len(plain) - 1)
            assert ("x " + raw + " y")[at[k]] == "y"


def test_idempotent():
    for raw, _, _ in CASES:
        assert canonical(canonical(raw)) == canonical(raw)
        assert unicodedata.normalize("NFC", canonical(raw)) == canonical(raw)
