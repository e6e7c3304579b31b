import datetime
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.dates import month_index, month_label, parse_month
from lectern.operators.intervals import periods_and_gaps

TODAY = datetime.date(2026, 6, 1)
SCHEMA = "k bigint, s int, e int, kind string"  # a column whose name clashes with a result column


def brute(spans):
    out = set()
    for k in {k for k, *_ in spans if k is not None}:
        on = {m for key, s, e in spans if key == k and s is not None and e is not None for m in range(s, e + 1)}
        months = sorted(on)
        runs = []
        for m in months:
            if runs and runs[-1][1] == m - 1:
                runs[-1][1] = m
            else:
                runs.append([m, m])
        out |= {(k, "period", a, b) for a, b in runs} | {(k, "gap", runs[i][1] + 1, runs[i + 1][0] - 1) for i in range(len(runs) - 1)}
    return sorted(out, key=repr)


def test_against_brute_force(spark, rows):
    r = random.Random(3)
    spans = [(r.randrange(1, 30), s, s + r.randrange(-2, 9)) for s in (r.randrange(0, 80) for _ in range(400))]
    spans += [(1, None, 5), (2, 5, None), (None, 1, 2), (3, 4, 9), (3, 4, 9)]
    df = spark.createDataFrame([(*x, "x") for x in spans], SCHEMA)
    assert rows(periods_and_gaps(df, "k", "s", "e")) == brute(spans)


def test_hot_key_and_empty(spark, rows):
    hot = spark.range(20_000).select(F.lit(7).cast("bigint").alias("k"), (F.col("id") % 40).cast("int").alias("s"), (F.col("id") % 40 + 1).cast("int").alias("e"))
    assert rows(periods_and_gaps(hot, "k", "s", "e")) == [(7, "period", 0, 40)]
    assert rows(periods_and_gaps(spark.createDataFrame([], SCHEMA), "k", "s", "e")) == []


def test_adjacent_months_leave_no_gap(spark, rows):
    df = spark.createDataFrame([(1, 10, 12, ""), (1, 13, 14, ""), (1, 17, 17, "")], SCHEMA)
    assert rows(periods_and_gaps(df, "k", "s", "e")) == [(1, "gap", 15, 16), (1, "period", 10, 14), (1, "period", 17, 17)]


@pytest.mark.parametrize(
    ("raw", "start", "end"),
    [
        ("2019", "2019-01", "2019-12"), (" 2019-07 ", "2019-07", "2019-07"), ("07/2019", "2019-07", "2019-07"), ("7.2019", "2019-07", "2019-07"), ("٠٧/٢٠١٩", "2019-07", "2019-07"), ("SEP. 2007", "2007-09", "2007-09"), ("März 2001", "2001-03", "2001-03"),
        ("août 2014", "2014-08", "2014-08"), ("مارس ٢٠١٠", "2010-03", "2010-03"), ("enero de 2010", "2010-01", "2010-01"), ("15.07.2019", "2019-07", "2019-07"), ("2019-07-15", "2019-07", "2019-07"), ("كانون الثاني 2010", "2010-01", "2010-01"),
        ("heute", None, "2026-06"), ("حتى الآن", None, "2026-06"), ("aujourd'hui", None, "2026-06"), ("-", None, None), ("n/a", None, None), ("", None, None), (None, None, None), ("13/2019", None, None), ("1850", None, None), ("Foo 2019", None, None),
    ],
)
def test_dates(spark, raw, start, end):
    df = spark.createDataFrame([(raw,)], "x string")
    got = df.select(month_label(parse_month(F.col("x"), end=False, today=TODAY)), month_label(parse_month(F.col("x"), end=True, today=TODAY))).first()
    assert tuple(got) == (start, end)


def test_month_index():
    assert month_index(2026, 6) == 2026 * 12 + 5
