"""Every core query that has SQL gives its rows, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

from lectern import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    want = duck.execute(catalog.SQL[name])
    cols = sorted(x[0] for x in want.description)
    order = [[x[0] for x in want.description].index(c) for c in cols]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    got = catalog.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == cols
    assert sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == expected


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
def test_results_do_not_depend_on_partitions(spark, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append([rows(catalog.QUERIES[q](spark, str(DATA))) for q in ("fit_score_requests", "p6_found", "group_rates", "text_budget", "screening_rank")])
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
