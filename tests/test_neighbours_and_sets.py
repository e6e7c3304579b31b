import random

import numpy as np
from pyspark.sql import functions as F

from lectern.operators.neighbours import cosine_top_k
from lectern.operators.similar_sets import similar_texts


def test_top_k_against_brute_force(spark, monkeypatch):
    from lectern.operators import neighbours

    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 50)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).round(2)
    m[5] = m[9]
    m[11] = 0
    df = spark.createDataFrame([(int(i), [float(x) for x in v], "c") for i, v in enumerate(m)] + [(None, [1.0] * 8, "c"), (900, None, "c")], "vec_id bigint, embedding array<double>, cosine string")
    got = {(r.query, r.place): (r.neighbour, round(r.cosine, 6)) for r in cosine_top_k(df.where("vec_id % 20 = 0 and embedding is not null"), df, "vec_id", "embedding", 5).collect()}
    norm = np.sqrt((m * m).sum(1))
    for q in range(0, 300, 20):
        c = np.round(np.divide(m @ m[q], norm * norm[q], out=np.zeros(300), where=norm * norm[q] > 0), 12)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-c[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, round(float(c[i]), 6)) for i in best]
    assert cosine_top_k(df.limit(0), df, "vec_id", "embedding", 5).count() == 0


def test_similar_texts_against_brute_force(spark, rows):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randrange(3, 60))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base:
        c = list(b)
        c[r.randrange(len(c))] = "changed"
        texts.append(" ".join(c))
    texts += [texts[0].upper() + "!", "", "...", "one", "One"] + ["long " * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "x", 0), (500, None, 0)], "doc_id bigint, text string, links int")
    got = {r.id: (r.class_id, r.copies, r.links) for r in similar_texts(df, "doc_id", "text").collect()}

    import re

    def sh(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    key = {i: " ".join(re.findall(r"[^\W_]+", t.lower())) for i, t in enumerate(texts)}
    rep = {k: min(i for i in key if key[i] == k) for k in set(key.values())}
    reps = [i for k, i in rep.items() if k]
    sets = {i: sh(texts[i]) for i in reps}
    links = {i: sum(1 for j in reps if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in reps}
    assert got == {i: (rep[key[i]], sum(1 for k in key.values() if k == key[i]), links.get(rep[key[i]], 0)) for i in key}
    assert rows(similar_texts(df.limit(0), "doc_id", "text")) == []


def test_similar_texts_near_the_threshold(spark, tmp_path):
    """Many texts of one boilerplate with a few runs changed, on both sides of the threshold; nothing is broadcast by an estimate of its size."""
    import re

    r = random.Random(7)
    base = [[r.choice([f"w{i}" for i in range(400)]) for _ in range(r.choice([6, 12, 40, 90]))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(12):
            c = [*b, *(f"x{r.randrange(9)}" for _ in range(r.randrange(len(b) // 6 + 1)))][r.randrange(len(b) // 8 + 1) :]
            for _ in range(r.randrange(3)):
                c[r.randrange(len(c))] = f"y{r.randrange(3)}"
            texts.append(" ".join(c))
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/t.parquet")
    found = similar_texts(spark.read.parquet(f"{tmp_path}/t.parquet"), "doc_id", "text")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", t)
        sets.setdefault(t, (i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])))
    links = {i: sum(1 for j, y in sets.values() if i != j and len(x & y) * 10 >= 8 * len(x | y)) for i, x in sets.values()}
    assert sum(links.values()) > 50
    assert {r.id: (r.class_id, r.links) for r in found.collect()} == {i: (sets[t][0], links[sets[t][0]]) for i, t in enumerate(texts)}


def test_odd_lengths_hide_no_neighbour(spark):
    data = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(40, [1.0, 2.0, 3.0]), (41, [0.0, 0.0])]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    got = cosine_top_k(df, df, "id", "v", 30).collect()
    near = {(r.query, r.neighbour): r.cosine for r in got}
    assert near[5, 6] > 0.99 and near[40, 5] == 0 and near[41, 5] == 0 and near[5, 40] == 0
    assert [r.neighbour for r in sorted(got, key=lambda r: r.place) if r.query == 40][:3] == [1, 2, 3]


def test_numbering_in_parts(spark):
    from lectern.operators.ranking import numbered

    df = spark.createDataFrame([(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", (i * 37) % 101, i) for i in range(400)], "g string, x int, i bigint").repartition(5)
    got = numbered(df, "g", [F.desc("x"), F.asc("i")], "place").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.place, -r.x, r.i))
    for rows in groups.values():
        assert [p for p, *_ in sorted(rows)] == list(range(1, len(rows) + 1)) and [x[1:] for x in sorted(rows)] == sorted(x[1:] for x in rows)
    assert sorted(r.place for r in numbered(df, None, [F.asc("i")], "place").collect()) == list(range(1, 401)) and numbered(df.limit(0), "g", [F.asc("i")], "place").count() == 0
