import json

from pyspark.sql import functions as F

from lectern.operators.nested import Node, Spec, emit, read_table, visit, write_tables
from lectern.plans.profile_spec import PROFILE, REPLY


def found(payload, spec=REPLY):
    return [(t, pp, p) for t, _, _, _, pp, p, present, _ in visit(1, payload, spec) if present]


def test_positions_count_blank_and_null_items():
    o = {"skills": [None, {"name": " "}, "Excel", {"name": "R", "evidence": {"page": 1, "quote": None}}]}
    assert found(json.dumps(o)) == [("skills", 0, 3), ("skills", 0, 4), ("skills.evidence", 4, 1)]


def test_wrappers_aliases_case_and_bare_items():
    o = {"Result": {"candidate": {"Identity": {"NAME": "A B", "email": "a@b.c", "phone": [None, "12"]}, "Work_Experience": {"company": "X", "projects": {"name": "P"}}, "educations": {"degree": ""}}}}
    assert found(json.dumps(o)) == [("identity.full_name", 0, 1), ("identity.emails", 0, 1), ("identity.phones", 0, 2), ("experiences", 0, 1), ("experiences.projects", 1, 1)]


def test_children_only_under_present_parents():
    o = {"experiences": [{"title": "", "evidence": {"page": 1, "quote": "q"}, "projects": [{"name": "p"}]}]}
    assert found(json.dumps(o)) == []


def test_evidence_is_present_by_page_or_quote():
    o = {"skills": [{"name": "a", "evidence": {"page": None, "quote": " "}}, {"name": "b", "evidence": {"page": 2, "quote": None}}, {"name": "c", "evidence": {"note": "x"}}]}
    assert ("skills.evidence", 2, 1) in found(json.dumps(o)) and ("skills.evidence", 1, 1) not in found(json.dumps(o))


def test_fences_and_broken_replies():
    assert found('```json\n{"skills": ["a"]}\n```') == [("skills", 0, 1)]
    for bad in ('{"skills": ["a"', "", "text", "[]", "null", "[" * 100_000, '```json\n{"skills": [\n```'):
        assert found(bad) == []


def test_emit_edge_cases(spark, rows):
    data = [(1, '{"skills": ["a"]}', "x"), (1, '{"skills": ["a"]}', "x"), (None, '{"skills": ["b"]}', "x"), (2, None, "x"), (3, "", "x"), (4, json.dumps({"skills": ["s"] * 5000}), "x")]
    df = spark.createDataFrame(data, "id bigint, j string, tag string")
    got = emit(df, "id", F.col("j"), REPLY)
    assert got.where("record_id = 1").count() == 2 and got.where("record_id = 4").count() == 5000 and got.where("record_id is null or record_id in (2, 3)").count() == 0
    assert rows(emit(df.limit(0), "id", F.col("j"), REPLY)) == []


def test_structs_and_tables_with_links(spark, rows, tmp_path):
    df = spark.sql("select 5L as id, named_struct('experiences', array(null, named_struct('title', 't', 'organization', 'o', 'evidence', named_struct('page', 1, 'quote', 'q')))) as r")
    tagged = emit(df, "id", F.col("r"), PROFILE)
    write_tables(tagged, str(tmp_path / "t"))
    roles = read_table(spark, str(tmp_path / "t"), "experiences", "title string, organization string")
    evidence = read_table(spark, str(tmp_path / "t"), "experiences.evidence", "page int, quote string")
    assert rows(roles.select("record_id", "pos", "title", "organization")) == [(5, 2, "t", "o")]
    assert rows(evidence.join(roles, evidence.parent_pk == roles.pk).select(evidence.quote, roles.title)) == [("q", "t")]
    assert "PartitionFilters: [isnotnull(tag" in roles._jdf.queryExecution().toString()


def test_any_spec():
    spec = Spec((Node("a", children=(Node("b", leaf=True),)),))
    assert found('{"A": [{"x": 1, "b": ["p", null, "q"]}]}', spec) == [("a", 0, 1), ("a.b", 1, 1), ("a.b", 1, 3)]
