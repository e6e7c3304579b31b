import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lectern.llm.mix import copies, pivotal, shares
from lectern.llm.pack import TightestFit, best_fit_decreasing, pack


def brute_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            k = min(fits)[1]
        else:
            rooms.append(capacity)
            k = len(rooms) - 1
        rooms[k] -= sizes[i]
        out[i] = k
    return out, rooms


def test_best_fit_against_brute_force():
    r = random.Random(1)
    for capacity in (1, 7, 64, 100):
        sizes = [r.randrange(1, capacity + 1) for _ in range(200)]
        got = best_fit_decreasing(np.array(sizes), capacity)
        filled = Counter()
        for s, c in zip(sizes, got, strict=True):
            filled[c] += s
        _, rooms = brute_fit(sizes, capacity)
        assert max(filled.values()) <= capacity
        assert sorted(capacity - x for x in filled.values()) == sorted(rooms)


def test_tree():
    t = TightestFit(10)
    for room, c in ((3, 0), (10, 1), (5, 2), (5, 3)):
        t.push(room, c)
    assert t.pop(4) == (5, 3) and t.pop(4) == (5, 2) and t.pop(4) == (10, 1) and t.pop(4) is None and t.pop(0) == (3, 0)


def test_pack(spark, monkeypatch):
    from lectern.llm import pack as module

    monkeypatch.setattr(module, "SHARD_ITEMS", 60)
    r = random.Random(4)
    data = [(i, r.choice([1, 5, 30, 99, 100, 101, 250, 1000])) for i in range(300)]
    df = spark.createDataFrame([(*x, "c") for x in data] + [(0, data[0][1], "c"), (None, 5, "c"), (900, None, "c"), (901, 0, "c"), (902, -4, "c")], "doc_id bigint, n int, container string")
    got = pack(df, "doc_id", "n", 100).collect()
    room, parts = Counter(), defaultdict(list)
    for x in got:
        room[x.container] += x["size"]
        parts[x.id].append((x.part_no, x.parts, x["size"]))
    assert max(room.values()) <= 100 and set(parts) == set(range(300))
    for i, n in data:
        assert sum(s for *_, s in parts[i]) == n and sorted(k for k, *_ in parts[i]) == list(range(1, parts[i][0][1] + 1)) and len(parts[i]) == -(-n // 100)
    assert sum(room.values()) / (100 * len(room)) > 0.9
    assert sorted(map(tuple, got)) == sorted(map(tuple, pack(df.repartition(7), "doc_id", "n", 100).collect()))
    assert pack(df.limit(0), "doc_id", "n", 100).count() == 0


def test_pivotal_keeps_sizes_and_odds():
    r = random.Random(0)
    sizes = [r.randrange(1, 50) for _ in range(60)]
    odds = [r.random() * 0.9 + 0.05 for _ in sizes]
    mean, whole = np.zeros(len(sizes)), sum(a * b for a, b in zip(sizes, odds, strict=True))
    for k in range(600):
        out, place, p = pivotal(sizes, odds, random.Random(k))
        got = sum(s * (p if x is None else x) for s, x in zip(sizes, out, strict=True))
        assert abs(got - whole) < 1e-6 and sum(x is None for x in out) == (place is not None)
        mean += [p if x is None else x for x in out]
    assert np.abs(mean / 600 - odds).max() < 0.1
    assert pivotal([], [], r) == ([], None, 0.0)


def test_mix(spark, monkeypatch):
    from lectern.llm import mix as module

    monkeypatch.setattr(module, "SHARD_ITEMS", 40)
    monkeypatch.setattr(module, "FAN_IN", 3)
    r = random.Random(5)
    data = [(i, r.choice("aaabc"), r.randrange(1, 40)) for i in range(900)] + [(1000, None, 5), (1001, "z", 5), (1002, "a", None), (1003, "a", 0)]
    df = spark.createDataFrame([(*x, 1) for x in [*data, data[0]]], "doc_id bigint, s string, n int, copies int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, None), ("none", 0.4, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = copies(df, "doc_id", "s", "n", targets)
    rows = got.collect()
    assert len({x.id for x in rows}) == len(rows) and {x.source for x in rows} == {"a", "b", "c"} and max(x.copies for x in rows if x.source != "b") == 1 and max(x.copies for x in rows) <= 2
    total = Counter()
    for x in rows:
        total[x.source] += x["size"] * x.copies
    whole = sum(total.values())
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(total[s] - whole * share) <= 80
    assert sorted(map(tuple, rows)) == sorted(map(tuple, copies(df.repartition(5), "doc_id", "s", "n", targets).collect()))
    report = {x.source: x for x in shares(got, targets.where("source is not null")).collect()}
    assert abs(sum(x.actual_share for x in report.values()) - 1) < 1e-9 and report["none"].tokens == 0
    assert copies(df.limit(0), "doc_id", "s", "n", targets).count() == 0
    capped = copies(df, "doc_id", "s", "n", targets, total=1e9).groupBy("source").agg(F.min("copies").alias("a"), F.max("copies").alias("b")).collect()
    assert {(x.source, x.a, x.b) for x in capped} == {("a", 1, 1), ("b", 2, 2), ("c", 1, 1)}
