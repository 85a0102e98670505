"""Facts, dislikes and preferences; changes to boards in words; refreshed rows, deletions, text helpers."""

import pytest
from pyspark.sql import functions as F

from sparkboard.functions import text
from sparkboard.operators import memory
from sparkboard.plans import resolve
from sparkboard.plans.edit import edit
from sparkboard.sources import web
from sparkboard.streaming import state


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.fixture
def facts(spark):
    return spark.createDataFrame([(1, "O extintor do galpão vence em março"), (2, "A cozinha tem oito funcionários"), (3, None)], "id long, text string")


def test_recall_and_forget(spark, facts):
    asked = spark.createDataFrame([("q", "quando vence o extintor")], "q string, w string")
    assert [r.doc for r in memory.recalled(facts, "id", "text", asked, "q", "w").collect()] == [1]
    assert sorted(r.id for r in memory.forgotten(facts, "id", "text", asked, "q", "w").collect()) == [2, 3]
    none = asked.limit(0)
    assert memory.forgotten(facts, "id", "text", none, "q", "w").count() == 3


def test_dislikes_are_of_one_intent_and_the_latest(spark):
    answers = spark.createDataFrame([("a", "gere a lista de riscos"), ("b", "gere a lista de riscos"), ("a", "outra coisa"), (None, None)], "intent string, text string")
    bad = spark.createDataFrame([("a", "gere a lista de riscos", 2), ("a", "outra coisa", 1)], "intent string, text string, at int")
    assert [(r.intent, r.text) for r in memory.disliked(answers, bad, most=1).collect()] == [("a", "gere a lista de riscos")]
    assert memory.disliked(answers, bad).count() == 2


def test_preferences(spark):
    uses = spark.createDataFrame([("u", "pdf", "resumido")] * 3 + [("u", "docx", "completo")] * 2 + [("v", "xlsx", "completo"), ("w", "b", None), ("w", "b", None), ("w", "a", None), ("w", "a", None), ("x", None, None)], "u string, f string, d string")
    assert {tuple(r) for r in memory.preferred(uses, "u", "f").collect()} == {("u", "pdf", 3), ("w", "a", 2)}
    assert {r.u: r.d for r in memory.preferred_detail(uses.where("u = 'v' or d = 'resumido' or f = 'docx'"), "u", "d").collect()} == {"u": None, "v": None}
    assert memory.preferred_detail(uses.where("d = 'resumido'"), "u", "d").first().d == "resumido"


@pytest.mark.parametrize(
    ("said", "op", "target", "names", "value"),
    [
        ("adicione as sub-abas Treinamentos, EPIs e Inspeções", "add_subtab", None, ["Treinamentos", "EPIs", "Inspeções"], None),
        ("Adicione uma sub-aba chamada Treinamentos, EPIs e Inspeções", "add_subtab", None, ["Treinamentos", "EPIs", "Inspeções"], None),
        ("renomeie a sub-aba Geral para Visão geral", "rename_subtab", "Geral", None, "Visão geral"),
        ("remova a sub-aba EPIs", "remove_subtab", "EPIs", None, None),
        ("renomeie a aba para Controle 2025", "rename_tab", None, None, "Controle 2025"),
        ("deixe o layout com 2 colunas", "set_columns", None, None, "2"),
        ("use o tema escuro", "set_theme", None, None, "dark"),
        ("mude a cor para #FF8800", "set_color", None, None, "#ff8800"),
        ("descrição: acompanhar extintores", "set_description", None, None, "acompanhar extintores"),
        ("mude o gráfico de acidentes para pizza", "set_kind", "acidentes", None, "donut"),
        ("deixe o gráfico de acidentes maior", "set_span", "acidentes", None, "+1"),
        ("mova a tabela de EPIs para o topo", "move_widget", "EPIs", None, "first"),
        ("mova a tabela de EPIs para a sub-aba Controle", "move_widget", "EPIs", None, "Controle"),
        ("renomeie o gráfico de acidentes para Acidentes do ano", "retitle_widget", "acidentes", None, "Acidentes do ano"),
        ("remova o gráfico de acidentes", "remove_widget", "acidentes", None, None),
        ("adicione um gráfico de acidentes por mês", "add_widget", None, None, None),
        ("bom dia", "none", None, None, None),
        (None, "none", None, None, None),
    ],
)
def test_edits(spark, said, op, target, names, value):
    e = one(spark, said, edit)
    assert (e.op, e.target, e.names, e.value) == (op, target, names, value)


def test_refreshed_rows_go_by_position(spark):
    sets = spark.createDataFrame([("d", "s", 0, 3), ("e", "s", 1, 1), ("f", "gone", 0, 2), ("g", "s", 0, 0)], "dataset string, source string, tbl int, width int")
    rows = spark.createDataFrame([("s", 0, 0, ["a", "b"]), ("s", 0, 1, ["1", None]), ("s", 1, 0, ["x"]), ("s", 1, 1, ["9", "8"])], "source string, tbl int, row int, cells array<string>")
    assert {(r.dataset, r.row, tuple(r.cells)) for r in web.refreshed_rows(sets, rows).collect()} == {("d", 1, ("1", "", "")), ("e", 1, ("9",))}


def test_deletions(spark, tmp_path):
    path = str(tmp_path / "kv")
    put = state.upsert_into(path, "id", "at")
    table = spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, False)], "id long, v string, at int, deleted boolean")
    put(table, 0)
    put(state.deletions(spark.createDataFrame([(1,)], "id long"), "id", "at", F.lit(2), table.schema), 1)
    assert [tuple(r) for r in state.latest(spark, path, "id", "at", "deleted").collect()] == [(2, "b", 1)]
    put(spark.createDataFrame([(1, "c", 3, None)], table.schema), 2)
    assert {r.v for r in state.latest(spark, path, "id", "at", "deleted").collect()} == {"b", "c"}


def test_text_helpers(spark):
    assert one(spark, ' "Aba  nova". ', text.clean_name) == "Aba nova"
    assert one(spark, None, text.clean_name) == ""
    assert one(spark, 'a aba "Meus EPIs" aqui', text.quoted) == "Meus EPIs"
    assert one(spark, "sem aspas", text.quoted) is None
    assert one(spark, "a, b; c e d\ne,, " + "x" * 50, text.split_list) == ["a", "b", "c", "d", "e"]
    assert one(spark, "Extintores e mangueiras", lambda c: text.highlighted(c, F.lit("o extintor"))) == "**Extintores** e mangueiras"
    assert one(spark, None, lambda c: text.highlighted(c, F.lit("x"))) is None


def test_fixed_kpis_and_bars(spark):
    assert tuple(resolve.fixed_kpi(spark, 4.5, "dias").first()) == (4.5, "dias", None)
    long = spark.createDataFrame([(f"a long label {k}",) for k in range(9)], "label string")
    assert resolve.bar_kind(long).first().kind == "hbar"
    assert resolve.bar_kind(long.limit(8)).first().kind == "bar"
