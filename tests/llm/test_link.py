import random

import pytest
from pyspark.sql import functions as F

from lectern.llm.link import GRAM_PLACES, NAME_FLOOR, TOKEN_SIMILARITY, NameJoin, _contacts, candidates, forms_of, grams, linked, people, token_stats
from lectern.llm.names import alike, edits, parse, similarity, skeleton

SCHEMA = "id bigint, name string, emails array<string>, phones array<string>, links array<string>, roles array<struct<org:string,s:int,sm:boolean,e:int,em:boolean>>, edu array<struct<inst:string,year:string>>, tokens string"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Tobias Veronique Isterivar", "T. Isterivar", True), ("Alexander Garrerly", "Garrerly Sascha", True), ("Prof. Margaret Dünkelho", "Dünkelho, Peggy", True), ("خالد القرعداني", "Khaled Al-Qardani", True), ("عبدالله يوسف الحجراوي", "Abdulla Yusuf El-Hajrawi", True),
        ("Strömorez, Eduardo", "EDUARDO STROEMOREZ", True), ("Aleaxnder Garrerly", "Alexander Garrerly", True), ("Matthias Garrino", "Odile Stefan Garrino", False), ("Anna Berg", "Peter Stein", False), ("Noura A. alMindawi", "نورة المينداوي", True),
    ],
)
def test_names(a, b, same):
    assert (similarity(parse(a), parse(b), lambda t: 5.0) >= 0.8) is same
    assert abs(similarity(parse(a), parse(b), lambda t: 5.0) - similarity(parse(b), parse(a), lambda t: 5.0)) < 1e-9


def test_small_parts():
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 2) == 3 and edits("", "ab", 2) == 2
    assert skeleton("hadbawi") == skeleton("الهضباوي") and alike("a", "anna") > 0.5 and alike("anna", "otto") == 0
    assert _contacts([" A@B.example ", "a [at] b [dot] example", None, ""], ["+1 555 410 3904", "(555) 410-3904 ext. 12", "12"], None) == ["ea@b.example", "p554103904"]


def brute(names):
    """Pairs of names of which a token of each has forms that are alike by their grams, and that are softly similar: all pairs tried."""
    near = lambda t, u: any(len(grams(f) & grams(h)) >= TOKEN_SIMILARITY * len(grams(f) | grams(h)) for f in forms_of(t) for h in forms_of(u))
    weight = [dict(zip(*n, strict=True)) for n in names]
    return {
        (i, j)
        for j in range(len(names))
        for i in range(j)
        if any(near(t, u) for t in names[i][0] for u in names[j][0]) and similarity(list(names[i][0]), list(names[j][0]), (weight[i] | weight[j]).__getitem__) >= NAME_FLOOR
    }


def test_join_against_brute_force():
    r = random.Random(3)
    given = ["anna", "ana", "liz", "elisabeth", "e", "khaled", "خالد", "bo", "otto", "oto", "zacharias", "zach"]
    family = ["garrino", "garino", "garrinno", "garrison", "torrwick", "torwick", "lundstad", "lundsatd", "abc", "abd", "li", "qardani", "قرعداني", "garrerly", "g"]
    weight = {t: r.uniform(1, 9) if len(t) > 1 else 0.3 for t in given + family}
    names = list(dict.fromkeys((t := tuple(r.choice(given) for _ in range(r.choice([0, 1, 1, 2]))) + (r.choice(family),), tuple(weight[x] for x in t)) for _ in range(150)))
    want, got = brute(names), set(NameJoin([r.randrange(9) for _ in range(GRAM_PLACES)]).pairs(names))
    missed = {p for p in want - got}
    assert got <= want and all(is_light(names[i], names[j]) for i, j in missed) and len(missed) * 50 <= len(want)


def is_light(a, b):
    """Whether no form of a heavy token has a partner by grams, so that only tokens alike in another way (an edit in two or three letters) make the names similar."""
    near = lambda t, u: any(len(grams(f) & grams(h)) >= TOKEN_SIMILARITY * len(grams(f) | grams(h)) for f in forms_of(t) for h in forms_of(u))
    for x, y in ((a, b), (b, a)):
        rest = sum(x[1])
        for t, w in sorted(zip(*x, strict=True), key=lambda p: -p[1]):
            if rest >= NAME_FLOOR * sum(x[1]) and any(near(t, u) for u in y[0]):
                return False
            rest -= w
    return True


def test_hot_evidence_is_split(spark):
    names = spark.range(400).select("id", F.array(F.lit("anna"), F.concat(F.lit("berg"), (F.col("id") % 3).cast("string"))).alias("tokens"), F.array(F.lit(1.0), F.lit(6.0)).alias("w"))
    keys = spark.range(400).select("id", F.lit(7).cast("long").alias("h"))
    assert candidates(names, keys, [0] * GRAM_PLACES).count() == 400 * 399 // 2
    import lectern.llm.link as module

    module.BLOCK, kept = 60, module.BLOCK
    try:
        split = candidates(names, keys, [0] * GRAM_PLACES)
        assert split.count() == 400 * 399 // 2 and split.where("a >= b").count() == 0
    finally:
        module.BLOCK = kept


def test_links(spark, rows):
    role = lambda org, s, e: (org, s, True, e, True)
    career = [role("Halden Labs", 24200, 24230), role("Pellow Rail", 24231, 24260)]
    p = lambda i, name, mail=(), phone=(), roles=(), edu=(): (i, name, list(mail), list(phone), None, list(roles), list(edu), "x")
    data = [
        p(1, "Tobias Isterivar", ["t@x.example"]), p(2, "T. Isterivar", ["T@X.example"]),  # one contact
        p(3, "Konrad Garrino", phone=["+49 555 386 0748"]), p(4, "Odile Garrino", phone=["0555/386 07 48"]),  # a household
        p(5, "Anna Lindstad", roles=career), p(6, "Anna Lindsatd", ["new@x.example"], roles=career),  # a career
        p(7, "Anna Lindstad", ["other@x.example"], roles=[role("Else", 24100, 24110)]),  # a namesake
        p(8, "خالد القرعداني", ["k@x.example"]), p(9, "Khaled Al-Qardani", ["k@x.example"]), p(10, None, ["k@x.example"]), p(11, "  ", ["k@x.example"]),
        *[p(20 + i, f"{g} {f}", ["desk@agency.example"]) for i, (g, f) in enumerate([("Anna", "Lindstad"), ("Bruno", "Keller"), ("Clara", "Moser"), ("Diego", "Ramos"), ("Emma", "Vogt"), ("Felix", "Weber"), ("Greta", "Zimmer"), ("Anna", "Lindstad")])],
        p(40, "Mononym", ["m@x.example"]), p(41, "Mononym", ["m@x.example"]), p(42, "Solo"), p(43, "x" * 5000, ["m@x.example"]),
    ]
    df = people(spark.createDataFrame(data, SCHEMA))
    assert rows(linked(df)) == [(1, 2), (40, 41), (5, 6), (8, 9)]
    assert linked(df.limit(0)).count() == 0
    assert token_stats(df).where("token = 'lindstad'").select("family").first()[0] is True


def test_every_pair_over_the_floor_is_a_candidate(spark, rows):
    """Initials, swapped letters and short words have no q-grams in common; few names and many give all pairs."""
    from lectern.llm.link import FEW_NAMES, alike_names

    r = random.Random(9)
    given = ["anna", "ana", "e", "elisabeth", "liz", "ali", "علي", "خالد", "khaled", "maria", "amrai", "li", "il", "abc", "acb", "ع"]
    family = ["b", "berg", "abcdef", "bacdfe", "isterivar", "siterivra", "lindstad", "g", "garrino", "قرعداني", "qardani", "wolfeschlegelsteinhausen", "wolfeshclegelsteinhasuen", "x" * 5000]
    weight = {t: r.uniform(1, 9) if len(t) > 1 else 0.3 for t in given + family}
    names = list(dict.fromkeys((t := tuple(r.sample(given, r.choice([0, 1, 1, 2]))) + (r.choice(family),), tuple(weight[x] for x in t)) for _ in range(200)))
    close = lambda a, b: similarity(list(a[0]), list(b[0]), (dict(zip(*a, strict=True)) | dict(zip(*b, strict=True))).__getitem__) >= NAME_FLOOR
    want = {(i, j) for j in range(len(names)) for i in range(j) if close(names[i], names[j])}
    join = NameJoin([0] * GRAM_PLACES)
    assert set(alike_names(join, names)) == want and len(want - set(join.pairs(names))) > 100
    few = names[:FEW_NAMES]
    assert set(alike_names(join, few)) == {p for p in want if p[1] < FEW_NAMES}

    p = lambda i, name: (i, name, ["a@x.example"], [], None, [], [], "x")
    assert rows(linked(people(spark.createDataFrame([p(1, "Ann Strngk"), p(2, "Ann Tsrnkg"), *[(k, f"Ann Wick{chr(87 + k)}", [], [], None, [], [], "x") for k in range(10, 14)]], SCHEMA)))) == [(1, 2)]
