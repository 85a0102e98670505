import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkboard.functions import dates, entities, numbers, risk, text
from sparkboard.functions.formula import FormulaError, compile_formula

def as_of():
    return F.lit("2026-09-28").cast("date")



def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("given", "wanted"), [("1.234,56", 1234.56), ("3,5 mil", 3500), ("1.234", 1234), ("0.500", 0.5), ("1,234", 1234), ("12,5", 12.5), ("R$ 10", 10), ("45%", 45), ("abc", None), ("", None), (None, None), ("1e3", None), ("2 mi", 2e6), ("-7,25", -7.25), ("1,234.5", 1234.5)])
def test_lenient_numbers(spark, given, wanted):
    assert value(spark, numbers.parse_number(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("15 de março de 2027", dt.date(2027, 3, 15)), ("30/09/26", dt.date(2026, 9, 30)), ("em 2026-01-05.", dt.date(2026, 1, 5)), ("31/02/2026", None), ("amanhã", dt.date(2026, 9, 29)), ("ontem", dt.date(2026, 9, 27)), ("4/7", dt.date(2026, 7, 4)), ("nunca", None), (None, None)])
def test_lenient_dates(spark, given, wanted):
    assert value(spark, dates.parse_date(F.lit(given).cast("string"), as_of())) == wanted


@pytest.mark.parametrize(("days", "wanted"), [(-1, "vencido"), (0, "a_vencer"), (30, "a_vencer"), (31, "em_dia"), (None, "sem_data")])
def test_validity(spark, days, wanted):
    assert value(spark, dates.validity(F.date_add(as_of(), F.lit(days).cast("int")), as_of())) == wanted


@pytest.mark.parametrize(("formula", "wanted"), [("A * 1000000 / H", 3e6 / 450000), ("2 ^ 3 + max(1, 4)", 12), ("max(1,4)", 4), ("-2^2", 4), ("2^3^2", 512), ("1,5 + 1", 2.5), ("1 / 0", None), ("round(-2.5)", -2), ("10 % 4", 2), ("sqrt(-1)", None), ("(1 + 2) * a", 9)])
def test_formulas(spark, formula, wanted):
    got = value(spark, compile_formula(formula, {"A": F.lit(3), "H": F.lit(450000)}))
    assert got is None if wanted is None else got == pytest.approx(wanted)


@pytest.mark.parametrize("formula", ["1 +", "(1", "nope", "1 2", "$"])
def test_formula_errors(spark, formula):
    with pytest.raises(FormulaError):
        compile_formula(formula, {})


def test_text_functions(spark):
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    none = F.array().cast("array<string>")
    assert value(spark, text.norm(F.lit("  Ação “Já” \n ÉPOCA "))) == 'acao "ja" epoca'
    assert value(spark, text.slug(F.lit("Olá, Mundo!"))) == "ola-mundo"
    assert value(spark, text.slug(F.lit("  "))) == "item"
    assert value(spark, text.jaccard(a, b)) == pytest.approx(1 / 3)
    assert value(spark, text.jaccard(none, none)) == 0
    assert value(spark, text.dice(F.lit("abc"), F.lit("abd"))) == 0.5
    assert value(spark, text.edit_distance(F.lit("abcdef"), F.lit("zzzzzz"))) == 3
    assert value(spark, text.stem(F.lit("treinamentos"))) == "trein"
    assert value(spark, text.title_case(F.lit("PLANO de ação DA empresa"))) == "PLANO de Ação da Empresa"
    assert value(spark, text.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b e c"
    assert value(spark, text.truncated(F.lit("abcdef"), 4)) == "abc…"
    assert value(spark, text.fnv1a(F.lit("a"))) == 0xE40C292C


def test_entities(spark):
    assert value(spark, entities.norm_ids(F.lit("Conforme NR-35, NR 10 e nr-06"))) == [6, 10, 35]
    assert value(spark, entities.certificate_ids(F.lit("Luva CA 12345 e capacete C.A. nº 98765"))) == ["12345", "98765"]
    assert value(spark, entities.entities(F.lit("a@b.com, a@b.com e c@d.org"), "emails")) == ["a@b.com", "c@d.org"]
    assert value(spark, entities.entities(F.lit("123.456.789-01"), "cpf")) == ["123.***.***-01"]
    assert [(x.label, x.value) for x in value(spark, entities.pairs(F.lit("jan 3, fev 5")))] == [("jan", 3.0), ("fev", 5.0)]


def test_risk(spark):
    assert [value(spark, risk.risk_level(F.lit(p), F.lit(s))) for p, s in ((2, 2), (1, 5), (2, 5), (4, 5))] == ["Baixo", "Moderado", "Alto", "Crítico"]
    assert value(spark, risk.noise_minutes(F.lit(95.0))) == 120
    assert value(spark, risk.noise_minutes(F.lit(86.0))) == 420
    assert value(spark, risk.noise_minutes(F.lit(84.0))) is None


def test_spreadsheet_letters_and_ticks():
    assert [numbers.column_name(k) for k in (0, 25, 26, 701)] == ["A", "Z", "AA", "ZZ"]
    assert numbers.column_index("AB12") == 27
    assert numbers.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10]
