from lectern.llm.link import linked, people
from tests.llm.test_link import SCHEMA


def test_spellings_do_not_make_a_crowd_and_crowds_are_joined_by_name(spark, rows):
    p = lambda i, name, mail, roles=(), edu=(): (i, name, [mail], [], None, list(roles), list(edu), "x")
    spelled = ["Tobias Isterivar"] * 5 + [f"Tobias {f}" for f in ("Isterivra", "Istervar", "Isterivarr", "Istreivar", "Isteriva", "Isterivaar", "Isterrivar")] + ["Isterivar, Tobias", "Isterivar Tobias"]
    hot = [p(i, name, "t@x.example") for i, name in enumerate(spelled, 1)]
    open_role, school = [("Halden Labs", 24200, True, None, True)], [("Norvik University", "1998")]
    desk = [p(50 + i, name, "desk@agency.example") for i, name in enumerate(["Bruno Keller", "Clara Moser", "Diego Ramos", "Emma Vogt", "Felix Weber", "Greta Zimmer", "Hugo Brandt", "Ida Falk"])]
    one = [p(60, "Anna Lindstad", "desk@agency.example", open_role, school), p(61, "Anna Lindstad", "desk@agency.example", open_role, school), p(62, "Anna Lindstad", "desk@agency.example")]
    got = rows(linked(people(spark.createDataFrame(hot + desk + one, SCHEMA))))
    n = len(spelled)
    assert set(got) == {(a, b) for a in range(1, n + 1) for b in range(a + 1, n + 1)} | {(60, 61)}
