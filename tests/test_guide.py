"""One search over a knowledge base, advice, titles and further report cores, against plain loops and odd rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkboard.operators import guide, reports
from sparkboard.operators.classify import Rule


@pytest.fixture(scope="module")
def base(spark):
    norms = spark.createDataFrame([(33, "Espaços confinados", "Entrada e resgate", "tanque silo"), (35, "Trabalho em altura", "Acima de dois metros", None), (6, "EPI", None, "luva capacete")], "number int, title string, summary string, keywords string")
    glossary = spark.createDataFrame([("sinalização vertical", "placas", "Placas ao lado da via"), ("CIPA", None, None)], "term string, aliases string, definition string")
    activities = spark.createDataFrame([("quente", "Trabalho a quente", ["solda", "maçarico"]), ("vazia", "Outra", None)], "activity string, name string, terms array<string>")
    advice = spark.createDataFrame([("epi_recusa", "Recusa de EPI", ["Converse com o trabalhador", "Registre a recusa"])], "advice string, title string, steps array<string>")
    return norms, glossary, activities, advice


QUESTIONS = ["o que é sinalização vertical?", "como soldar com maçarico no trabalho a quente", "recusa", "tanque", "espasos confinados", "nada que exista por aqui", "", None, "trabalho", "NR-35"]


def test_one_index_answers(spark, base):
    known = guide.entries(*base)
    assert known.count() == 8 and known.select("entry").distinct().count() == 8
    asked = spark.createDataFrame([*enumerate(QUESTIONS), (None, "recusa"), (2, "recusa")], "q int, t string")
    got = {r.question: (r.kind, r.id) for r in guide.answers(asked, "q", "t", known).collect()}
    assert set(got) == {*range(len(QUESTIONS)), None}
    assert got[0] == ("glossary", "sinalização vertical") and got[1] == ("activity", "quente") and got[2] == ("advice", "epi_recusa")
    assert got[9] == (None, None)  # one word of eight entries scores below the bound
    assert {(r.kind, r.id) for r in guide.found(asked, "q", "t", known, k=1).where("question = 9").collect()} == {("norm", "35")}
    assert got[4] == ("norm", "33")  # a typing error of one letter
    assert got[5] == got[6] == got[7] == got[None] == (None, None)
    assert guide.answers(asked, "q", "t", known.limit(0)).where("kind IS NOT NULL").count() == 0
    assert guide.answers(asked.limit(0), "q", "t", known).count() == 0


def test_scores_by_loops(spark, base):
    known = guide.entries(*base)
    texts = {r.entry: "".join(c if c.isalnum() or c == "-" else " " for c in guide_norm(r.t)).split() for r in known.collect()}
    mean = sum(max(len(w), 0) for w in texts.values()) / len(texts)
    want = {}
    for q, said in enumerate(QUESTIONS):
        terms = set("".join(c if c.isalnum() or c == "-" else " " for c in guide_norm(said or "")).split())
        for entry, w in texts.items():
            score = sum(math.log(1 + (len(texts) - d + 0.5) / (d + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.28 + 0.72 * len(w) / mean)) for t in terms if (tf := Counter(w)[t]) for d in [sum(t in x for x in texts.values())])
            if score > 0.01:
                want[q, entry] = (round(score, 6), round(sum(t in w for t in terms) / len(terms), 6))
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "q int, t string")
    got = guide.found(asked, "q", "t", known, k=99, fuzzy=False, stems=False).collect()
    assert {(r.question, f"{r.kind}:{r.id}"): (round(r.score, 6), round(r.coverage, 6)) for r in got} == want
    best = guide.answers(asked, "q", "t", known, fuzzy=False, stems=False).where("kind IS NOT NULL").collect()
    top = {q: max((s, c) for (k, _), (s, c) in want.items() if k == q) for q, _ in want}
    assert {r.question for r in best} == {q for q, (s, c) in top.items() if s > 2.2 and c >= 0.4} and len(best) >= 2


def guide_norm(text):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def test_advice_and_titles(spark):
    rules = (Rule("epi_recusa", r"\b(nao usa|recusa)\b.*\b(epi|protetor)"), Rule("epi", r"\bepi\b"))
    df = spark.createDataFrame([(1, "Meu time não usa protetor auricular, o que faço?"), (2, "Recusa de EPI"), (3, "epi"), (4, "outro"), (5, ""), (6, None)], "id int, t string")
    assert {r.id: r.a for r in df.select("id", guide.advice_for(F.col("t"), rules).alias("a")).collect()} == {1: "epi_recusa", 2: "epi_recusa", 3: "epi", 4: None, 5: None, 6: None}
    rows = [(1, "x", "doc_generate", "APR", None, None), (2, "x", "nr_info", None, "6", "EPI"), (3, "Uma aba com muitos indicadores de acidentes e treinamentos", "tab_create", None, None, None), (4, None, "unknown", None, None, None), (5, "a b", "unknown", None, None, None), (6, "Empilhadeira empilhadeira galpão", None, None, None, None), (7, "oi", "nr_info", None, None, None), (8, "oi", "define", None, None, None)]
    chats = spark.createDataFrame(rows, "chat int, said string, intent string, document string, norm string, title string")
    slots = {"intent": F.col("intent"), "document": F.col("document"), "norm": F.col("norm"), "norm_title": F.col("title")}
    got = {r.chat: r.title for r in guide.titles(chats, "chat", "said", slots).collect()}
    assert got == {1: "APR", 2: "NR-06 — EPI", 3: "Abas — Uma aba com muitos indicadores de acidentes…"[: 7 + 39].rstrip() + "…", 4: "", 5: "a b", 6: "Empilhadeira, galpao", 7: "oi", 8: "oi"}
    assert guide.titles(chats.limit(0), "chat", "said", slots).count() == 0


def test_report_cores(spark):
    cases = spark.createDataFrame([(1, "Fiação exposta no painel e piso molhado"), (2, "tudo certo"), (3, None), (4, "")], "id int, t string")
    terms = (("eletricidade", ("fiação", "painel")), ("piso escorregadio", ("molhado",)))
    got = sorted((r.case, r.position, r.hazard, r.severity) for r in reports.inspections(cases, "id", "t", terms).collect())
    none = "Condição insegura descrita"
    assert got == [(1, 1, "eletricidade", "Alto"), (1, 2, "piso escorregadio", "Alto"), *((k, 1, none, "Moderado") for k in (2, 3, 4))]
    calls = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "b", None), (4, "b", "y")], "id int, activity string, advice string")
    talks = spark.createDataFrame([("a", ["p"]), ("b", [])], "activity string, points array<string>")
    steps = spark.createDataFrame([("x", list("123456")), ("y", None)], "advice string, steps array<string>")
    said = sorted((r.call, r.position, r.subject, r.point) for r in reports.bulletins(calls, "id", "activity", "advice", talks, steps).collect())
    assert said[0] == (1, 1, "a", "p") and [x[3] for x in said if x[0] == 2] == list("12345")
    assert [x[2:] for x in said if x[0] >= 3] == [("Segurança em primeiro lugar", p) for p in reports.POINTS] * 2
    hazards = spark.createDataFrame([("a", f"h{k}", k % 5 + 1, 5) for k in range(7)], "activity string, hazard string, p int, s int")
    courses = spark.createDataFrame([(1, "a", None), (2, "a", 10), (3, "zz", 11), (4, None, None)], "id int, activity string, norm int")
    contents = spark.createDataFrame([(10, 40, ["m1", "m2"]), (11, 8, [])], "norm int, hours int, modules array<string>")
    made = sorted((r.course, r.position, r.module, r.hours) for r in reports.trainings(courses, "id", "activity", "norm", contents, hazards).collect())
    assert [x[2][:2] for x in made if x[0] == 1] == ["No", "h4", "h3", "h2", "h1", "h6", "EP", "Si"]
    assert [x[2:] for x in made if x[0] == 2] == [("m1", 40), ("m2", 40)] and [len([x for x in made if x[0] == k]) for k in (3, 4)] == [3, 3]
