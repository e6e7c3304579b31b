import random

from lectern.operators.resolve import absorb


def brute(edges):
    earlier = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            earlier.setdefault(max(a, b), set()).add(min(a, b))
    taken = {}
    for b in sorted(earlier):
        free = [a for a in sorted(earlier[b]) if a not in taken]
        if free:
            taken[b] = free[0]
    return sorted(taken.items(), key=repr)


def test_against_brute_force(spark, rows):
    r = random.Random(6)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(1, 1), (None, 3), (2, None)] + [(i, i + 1) for i in range(100, 112)]
    df = spark.createDataFrame([(*e, 0) for e in edges + edges[:5]], "earlier bigint, later bigint, target int")
    assert rows(absorb(df)) == brute(edges)
    assert rows(absorb(df.limit(0))) == []


def test_a_taken_in_node_takes_nobody_in(spark, rows):
    df = spark.createDataFrame([(1, 2), (2, 3)], "earlier bigint, later bigint")
    assert rows(absorb(df)) == [(2, 1)]
