"""Every request is judged against the profiles of its own session; the whole job against SQL on more than the smallest data."""

from pathlib import Path

import duckdb
import pytest

from lectern import catalog
from lectern.plans import matching

DATA = Path("/root/testdata/sf0.01")
NAMES = ["fit_score_requests", "gap_counts_requests", "verdict_lists_requests", "verdict_matrix_requests"]


@pytest.mark.skipif(not DATA.exists(), reason="no test data here")
@pytest.mark.parametrize("name", NAMES)
def test_every_request(spark, monkeypatch, name):
    monkeypatch.setattr(matching, "PROFILE_BLOCK", 7)  # the large session in many blocks
    monkeypatch.setattr(matching, "REQUEST_BLOCK", 5)
    duck = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        duck.execute(f"create view {p.stem} as select * from '{p}'")
    want = duck.execute(catalog.SQL[name])
    cols = [x[0] for x in want.description]
    expected = sorted(map(repr, want.fetchall()))
    got = catalog.QUERIES[name](spark, str(DATA)).select(*cols).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected
    assert len({r.request_id for r in got}) > 100
