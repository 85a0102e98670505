"""Searches in a knowledge base, dates in texts, types of documents, widgets from requests."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkboard.functions import entities
from sparkboard.operators import classify, knowledge, lookup, retrieval
from sparkboard.plans import request

ACTIVITIES = [
    ("altura", "Trabalho em altura", ["altura", "trabalho em altura"]),
    ("telhado", "Serviço em telhado", ["telhado", "telha", "cobertura"]),
    ("eletrica", "Serviço elétrico", ["eletrica", "painel eletrico", "troca de lampada"]),
    ("escada", "Uso de escada", ["escada"]),
    ("empilhadeira", "Operação de empilhadeira", ["empilhadeira"]),
    ("confinado", "Espaço confinado", ["espaco confinado", "tanque"]),
]


@pytest.fixture(scope="module")
def base(spark):
    activities = spark.createDataFrame(ACTIVITIES, "activity string, name string, terms array<string>")
    hints = spark.createDataFrame([("lampada", ["eletrica", "escada"]), ("troca de telhado", ["telhado", "altura"])], "term string, activities array<string>")
    implied = spark.createDataFrame([("telhado", "altura")], "activity string, contains string")
    return activities, hints, implied


def test_activities(spark, base):
    texts = ["APR para troca de lâmpada no galpão", "apr de empilhadera", "troca de telhado", "Painéis e escadas", "nada disso", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = collections.defaultdict(list)
    for r in sorted(knowledge.find_activities(docs, "id", "t", *base).collect(), key=lambda r: (r.doc, r.rank)):
        found[r.doc].append(r.activity)
    assert found == {0: ["eletrica", "escada"], 1: ["empilhadeira"], 2: ["telhado"], 3: ["escada"]}
    assert knowledge.find_activities(docs.limit(0), "id", "t", *base).count() == 0


def test_norms_and_glossary(spark):
    norms = spark.createDataFrame([(33, "Espaços confinados", "tanque silo", "Entrada segura em espaço confinado", False), (35, "Trabalho em altura", "queda cinto", "Acima de dois metros", False), (2, "Inspeção prévia", "espaço confinado", "Revogada", True), (10, "Instalações elétricas", "painel", "Serviços em eletricidade", None)], "number int, title string, keywords string, summary string, revoked boolean")
    asked = spark.createDataFrame([(1, "qual nr fala de espaço confinado"), (2, "cinto contra queda")], "q int, t string")
    assert {(r["query"], r.doc) for r in knowledge.search_norms(asked, "q", "t", norms, 1).collect()} == {(1, 33), (2, 35)}
    glossary = spark.createDataFrame([("sinalização", "placas", "Avisos"), ("sinalização vertical", None, "Placas em postes"), ("EPI", "equipamento de proteção individual", "Proteção")], "term string, aliases string, definition string")
    docs = spark.createDataFrame([(1, "o que é sinalização vertical?"), (2, "o que é EPI"), (3, "um texto longo sobre muitas coisas e epi também"), (4, None)], "id int, t string")
    assert {r.doc: r.term for r in knowledge.find_glossary(docs, "id", "t", glossary).collect()} == {1: "sinalização vertical", 2: "EPI"}


def test_dates_in_texts(spark):
    rows = [
        (1, "Treinamento com validade até 10/01/2026."),
        (2, "Criado em 05/03/2024. Validade: 15 de outubro de 2026 e próxima inspeção 2027-01-02"),
        (3, "Nome | Validade\nExtintor | 01/01/2020"),
        (4, None),
        (5, "vence 01/10/2026, vence 01/10/2026"),
        (6, "31/02/2026 nada"),
    ]
    t = spark.createDataFrame(rows, "id int, t string").select("id", entities.validities_in(F.col("t"), F.lit("2026-09-28").cast("date")).alias("v"), entities.dates_in(F.col("t"), F.lit("2026-09-28").cast("date")).alias("d"))
    got = {r.id: r for r in t.collect()}
    assert {k: [x.status for x in r.v] for k, r in got.items()} == {1: ["vencido"], 2: ["vence em breve", "válido"], 3: [], 4: [], 5: ["vence em breve"] * 2, 6: []}
    assert [x.date for x in got[2].d] == [datetime.date(2024, 3, 5), datetime.date(2026, 10, 15), datetime.date(2027, 1, 2)]
    assert got[1].v[0].days == -261 and got[1].d[0].context == "Treinamento com validade até 10/01/2026."
    assert got[2].d[0].context == "Criado em 05/03/2024"


def test_guards_lose_no_entity(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "50 %", "3%", "R$ 12,50", "R$7", "ONU 1234", "UN 4321", "UN1111", "www.x.org", "12/12", "word", "@", "%", "R$"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for k in range(300)] + [(999, None)], "id int, t string")
    for kind in ("emails", "percent", "money", "onu"):
        r = docs.select(entities.entities(F.col("t"), kind).alias("a"), entities.found(F.col("t"), entities.PATTERNS[kind]).alias("b")).collect()
        assert all(x.a == x.b for x in r) and any(x.a for x in r)


def test_document_types(spark):
    docs = spark.createDataFrame([(1, "ANÁLISE PRELIMINAR DE RISCO\nEtapa, perigo, medidas de controle"), (2, "Ata da reunião da CIPA. Presentes: pauta"), (3, "qualquer texto"), (4, "Certificamos que Ana concluiu o curso, carga horária 8 h")], "id int, t string")
    types = classify.doc_type(classify.doc_type_scores(docs, "id", "t", classify.DOC_TYPES), [x.name for x in classify.DOC_TYPES])
    assert {r.doc: r.type for r in types.collect()} == {1: "apr", 2: "ata", 3: "documento", 4: "certificado"}


def test_widgets_from_requests(spark):
    asked = [
        (1, "adicione um gráfico de pizza por setor"), (2, "contador de dias sem acidentes desde 10/02/2026"), (3, "calculadora de taxa de gravidade"),
        (4, "meta de 150 com 30 feitos"), (5, "checklist com itens: luvas, botas e capacete"), (6, "tabela de registros"), (7, "indicador de multas com valor 12%"),
        (8, "gráfico de linha: jan 3, fev 5, mar 2"), (9, "nota dizendo usar capacete"), (10, "grafico de acidentes por mes"), (11, "linha do tempo do projeto"), (12, None), (13, "formulário de cadastro"),
    ]
    got = {r.id: r for r in spark.createDataFrame(asked, "id int, t string").select("id", request.widget(F.col("t"), F.lit("2026-09-28").cast("date")).alias("w")).select("id", "w.*").collect()}
    assert {k: r.type for k, r in got.items()} == {1: "chart", 2: "counter", 3: "calc", 4: "progress", 5: "checklist", 6: "table", 7: "kpi", 8: "chart", 9: "note", 10: "chart", 11: "timeline", 12: "chart", 13: "form"}
    assert (got[1].kind, got[1].by) == ("donut", "setor") and got[10].by == "mes" and got[8].kind == "line"
    assert got[2].since == datetime.date(2026, 2, 10) and got[3].formula == "gravidade"
    assert (got[4].value, got[4].max) == (30.0, 150.0) and got[7].value == 12.0
    assert got[5].items == ["luvas", "botas", "capacete"] and got[9].text == "usar capacete"
    assert [(p.label, p.value) for p in got[8].pairs] == [("jan", 3.0), ("fev", 5.0), ("mar", 2.0)]


def test_bm25_of_a_query_set_equals_the_whole_index(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 30)))) for k in range(80)], "id int, t string")
    asked = spark.createDataFrame([(1, "a c"), (2, "h x")], "q int, t string")
    only = asked.select(F.explode(F.split("t", " ")).alias("token")).distinct()
    rows = lambda i: sorted((r["query"], r.doc, round(r.score, 9), r.coverage) for r in retrieval.bm25(i, asked, "q", "t", k=5, fuzzy=False, stems=False).collect())
    assert rows(retrieval.build_index(docs, "id", "t", stems=False)) == rows(retrieval.build_index(docs, "id", "t", stems=False, only=only))


def test_coverage_against_all_pairs(spark):
    rng = random.Random(6)
    draw = lambda n: [f"w{int(rng.paretovariate(0.7))}" for _ in range(n)]
    docs, items = [draw(rng.randint(1, 40)) for _ in range(60)], [draw(rng.randint(1, 12)) for _ in range(30)]
    want = {(i, d): len(set(a) & set(b)) / len(set(a)) for i, a in enumerate(items) for d, b in enumerate(docs) if len(set(a) & set(b)) / len(set(a)) >= 0.8}
    frame = lambda x: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(x)], "id int, t string").select("id", F.split("t", " ").alias("w"))
    got = lookup.covered(frame(items), "id", "w", frame(docs), "id", "w", 0.8)
    assert {(r.item, r.doc): r.coverage for r in got.collect()} == want and len(want) > 20
