import pytest

from lectern.query import View, answer, parse
from lectern.streaming.sessions import fresh_files, user_sessions, windowed_counts


@pytest.fixture
def profiles(spark):
    data = [(1, 1, 8.0, ["FastAPI", "SQL"], False), (2, 2, 11.0, ["SQL"], False), (3, 3, 3.0, ["Docker"], True), (4, 4, None, [], False)]
    return spark.createDataFrame(data, "profile_id bigint, display_no int, years double, skills array<string>, weak boolean")


@pytest.mark.parametrize(
    ("text", "kind"),
    [("how many candidates", "count"), ("compare 1 and 2", "compare"), ("exclude the weak ones", "exclude"), ("who has FastAPI and at least 5 years?", "years"), ("shortlist the best", "shortlist"), ("rank them", "rank"), ("who knows SQL?", "who_has"), ("hello", "rank"), ("start over", "reset")],
)
def test_intents(text, kind):
    assert parse(text).kind == kind


def test_thresholds_and_references():
    assert parse("more than 5 years").years == 5 and not parse("more than 5 years").below
    assert parse("under 3 years").below and parse("5+ years").years == 5
    assert parse("compare candidate 1 and 3").refs == (1, 3) and parse("top 7").top == 7


def test_turns(profiles):
    ids = lambda df: [r.profile_id for r in df.collect()]
    df, v = answer(profiles, "at least 5 years")
    assert ids(df) == [2, 1] and set(ids(v.current)) == {1, 2}
    df, v = answer(profiles, "who knows fastapi?", v)
    assert ids(df) == [1] and ids(v.current) == [1]
    df, same = answer(profiles, "who knows cobol?", v)
    assert ids(df) == [] and ids(same.current) == [1]
    df, v = answer(profiles, "more than 40 years", v)
    assert v.current is None
    assert ids(answer(profiles, "top 2", v)[0]) == [2, 1]
    assert ids(answer(profiles, "exclude candidate 1 and 2", View())[0]) == [3, 4]
    assert answer(profiles, "how many")[0].first() == (4, 1)
    assert sorted(ids(answer(profiles, "start over", v)[0])) == [1, 2, 3, 4]


def test_skills_match_in_part_both_ways(profiles):
    ids = lambda text: [r.profile_id for r in answer(profiles, text)[0].collect()]
    assert ids("who knows fast?") == [1] and ids("who has docker compose?") == [3] and ids("who knows sql?") == [1, 2]


def test_references(profiles):
    from pyspark.sql import functions as F

    named = profiles.withColumn("name", F.element_at(F.array(*map(F.lit, ["Anna Berg", "Bruno Keller", "Clara Moser", None])), F.col("display_no")))
    ids = lambda df: [r.profile_id for r in df.collect()]
    ask = lambda text, view=None: answer(named, text, view)
    assert ids(ask("compare the second and the third")[0]) == [2, 3] and ids(ask("compare 1 vs 4")[0]) == [1, 4] and ids(ask("compare anna and bruno keller")[0]) == [1, 2]
    assert ids(ask("compare c_001 & c_003")[0]) == [1, 3] and ids(ask("exclude clara")[0]) == [1, 2, 4]
    _, v = ask("shortlist the top 2")
    assert sorted(ids(ask("rank them", v)[0])) == [1, 2] and sorted(ids(ask("exclude the shortlist", v)[0])) == [3, 4]


def test_ranking_for_a_job(profiles):
    from lectern.query import Criteria

    df, v = answer(profiles, "rank them for this jd", job=Criteria(("SQL", "FastAPI"), 8, "sql fastapi backend"))
    got = [(r.profile_id, r.coverage, r.score) for r in df.collect()]
    assert [g[0] for g in got] == [1, 2, 4, 3] or [g[0] for g in got] == [1, 2, 3, 4]
    assert got[0][1] == 1.0 and got[1][1] == 0.5 and got[0][2] > got[1][2] and v.job is not None
    weak = next(r for r in df.collect() if r.profile_id == 3)
    assert weak.score == round((0.25 * 3 / 8) * 0.85, 4)


def stream(spark, df, path, name, f, mode="append"):
    df.write.mode("overwrite").parquet(path)
    q = f(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    events = spark.sql("""
        select timestamp_ntz'2026-01-01 10:00:00' as ts, 1L as user_id, 'a' as event_type, 1.0 as value union all select timestamp_ntz'2026-01-01 12:00:00', 1L, 'a', 2.0
        union all select timestamp_ntz'2026-01-01 14:00:01', 1L, 'b', 3.0 union all select timestamp_ntz'2026-01-09 00:00:00', 2L, 'a', 4.0""")
    got = stream(spark, events, str(tmp_path / "e"), "sess", user_sessions)
    assert sorted((r.user_id, r.events, r.value) for r in got.collect()) == [(1, 1, 3.0), (1, 2, 3.0)]
    got = stream(spark, events, str(tmp_path / "w"), "win", windowed_counts)
    assert sorted((r.event_type, r.n) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 1)]
    files = spark.sql("select 'h1' as hash, timestamp'2026-01-01 10:00:00' as ingested_at union all select 'h1', timestamp'2026-01-01 11:00:00' union all select 'h2', timestamp'2026-01-01 11:00:00'")
    assert stream(spark, files, str(tmp_path / "f"), "fresh", fresh_files).count() == 2
    assert {(r.user_id, r.events) for r in user_sessions(events).collect()} == {(1, 2), (1, 1), (2, 1)}
