import random

import pytest

from lectern.llm.langmodel import LANGS, label_language, train
from lectern.llm.language import languages

SENTENCES = {
    "en": ["We lead the work on new plans with the team.", "The office finished the review of old files in spring.", "Nobody asked about the way they keep their notes."],
    "de": ["Wir leiten die Arbeit an neuen Plänen mit der Gruppe.", "Das Büro beendete im Frühjahr die Durchsicht der alten Akten.", "Niemand fragte danach, wie sie ihre Notizen führen."],
    "fr": ["Nous menons le travail sur les nouveaux plans avec l'équipe.", "Le bureau a terminé la revue des anciens dossiers au printemps.", "Personne n'a demandé comment ils tiennent leurs notes."],
    "es": ["Llevamos el trabajo en los planes nuevos con el equipo.", "La oficina terminó la revisión de los expedientes antiguos.", "Nadie preguntó por la forma en que guardan sus notas."],
    "pt": ["Conduzimos o trabalho nos planos novos com a equipa.", "O escritório terminou a revisão dos processos antigos na primavera.", "Ninguém perguntou pela forma como guardam as suas notas."],
    "ar": ["نقود العمل على الخطط الجديدة مع الفريق.", "أنهى المكتب مراجعة الملفات القديمة في الربيع.", "لم يسأل أحد عن طريقة حفظ الملاحظات لديهم."],
}


def corpus(n, wrong=0.15):
    r = random.Random(1)
    out = []
    for _ in range(n):
        lang = r.choice(LANGS)
        text = " ".join(r.choice(SENTENCES[lang]) for _ in range(4))
        out.append((text, r.choice(LANGS) if r.random() < wrong else lang, lang))
    return out


@pytest.mark.parametrize(("label", "lang"), [("en-GB", "en"), ("English", "en"), ("DEU", "de"), ("pt_BR", "pt"), ("Français", "fr"), (" ara ", "ar"), ("und", None), ("", None), (None, None), ("??", None), ("it", None)])
def test_labels(label, lang):
    assert label_language(label) == lang


def test_model_survives_wrong_labels_on_held_out_texts():
    rows = corpus(600)
    model = train((t, lab) for t, lab, _ in rows[:300])
    hits = sum(LANGS[int(model.paragraphs(t)[:, 0].sum(axis=0).argmax())] == true for t, _, true in rows[300:])
    assert hits >= 0.99 * 300


def test_operator(spark, rows):
    base = corpus(240)
    data = [("document", i, "s", f"h{i % 7}", t, lab) for i, (t, lab, _) in enumerate(base)]
    mixed = "\n\n".join([" ".join(SENTENCES["de"]), "Skills\nPython, SQL", " ".join(SENTENCES["fr"]), " ".join(SENTENCES["de"])])
    extra = [("document", 900, None, None, mixed, "de-AT"), ("document", 901, "s", "h1", None, "en"), ("document", 902, "s", "h1", "", "fr"), ("document", 903, None, "h9", "12345 ???", None), ("document", None, "s", "h", "x", "en"), ("document", 904, "s", "h1", " ".join(SENTENCES["pt"]) * 3000, None)]
    df = spark.createDataFrame([(*x, "x") for x in [*data, *extra, data[0], data[0]]], "origin string, item_id bigint, source string, host string, text string, label string, lang string")
    got = languages(df).collect()
    main = {r.item_id: r for r in got if r.seg_no == 0}
    assert sum(main[i].lang == true for i, (_, _, true) in enumerate(base)) >= 0.99 * 240
    assert all(main[i].label_right == (lab == main[i].lang) for i, (_, lab, _) in enumerate(base))
    assert [(r.seg_no, r.lang) for r in got if r.item_id == 900] == [(0, "de"), (3, "fr")] and main[900].label_right
    assert 901 not in main and None not in main and main[902].lang == "fr" and not main[903].label_right and main[904].lang == "pt"
    assert len([r for r in got if r.item_id == 0]) == 1 and all(0 < r.confidence <= 1 for r in got)
    assert languages(df.limit(0)).count() == 0


def test_short_paragraphs_and_the_label_speak(spark):
    """A paragraph of four words is enough if they are clear; names and skills stay with the main language, whatever the label says."""
    base = [("document", i, "s", f"h{i % 5}", t, lab) for i, (t, lab, _) in enumerate(corpus(200))]
    de = " ".join(SENTENCES["de"])
    data = [*base, ("document", 900, "s", "h1", f"{de}\n\nNous menons le travail.\n\n{de}", "fr"), ("document", 901, "s", "h1", f"{de}\n\nPython, Kafka, Anna Berg, Norvik 1999", "de"), ("document", 902, "s", "h1", f"{de}\n\n{SENTENCES['ar'][0]}", None)]
    got = languages(spark.createDataFrame(data, "origin string, item_id bigint, source string, host string, text string, label string")).collect()
    of = lambda i: [(r.seg_no, r.lang) for r in got if r.item_id == i]
    assert of(900) == [(0, "de"), (2, "fr")] and of(901) == [(0, "de")] and of(902) == [(0, "de"), (2, "ar")]
    assert all(r.confidence > 0.5 for r in got if r.seg_no > 0)
