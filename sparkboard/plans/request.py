"""Widgets from requests in words: one struct of columns for a table of requests.

Rules name the widget, patterns its values. The struct says what was asked for; which
dataset and column a name means is for ``operators.lookup.nearest_name`` to find.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.entities import pairs, url
from ..functions.numbers import parse_number
from ..functions.text import let, norm
from ..operators.classify import Rule, first_of

#: Words that ask for a widget, the first that is found decides.
WIDGET_RULES = (
    Rule("counter", r"contador|dias sem"),
    Rule("calc", r"calculadora"),
    Rule("progress", r"meta|progresso"),
    Rule("checklist", r"checklist|lista de verificacao|lista de tarefas|tarefas|pendencias"),
    Rule("links", r"^(?!.*grafico).*\blinks?\b"),
    Rule("site", r"(leitor|site|pagina externa).*(https?://|www\.)|(https?://|www\.).*(leitor|site|pagina externa)"),
    Rule("note", r"^(?!.*(grafico|tabela)).*(nota|anotacao|texto|aviso|recado|observacao)"),
    Rule("timeline", r"linha do tempo|timeline|cronograma"),
    Rule("form", r"^(?!.*grafico).*(formulario|cadastro)"),
    Rule("table", r"^(?!.*grafico).*(tabela|registro de)"),
    Rule("kpi", r"^(?!.*grafico).*(kpi|indicador|card|numero em destaque)"),
)
#: Words that ask for a kind of chart or a ready formula.
CHART_RULES = (
    Rule("donut", r"pizza|rosca|donut|torta"),
    Rule("hbar", r"barras? horizonta|ranking"),
    Rule("area", r"\barea\b"),
    Rule("line", r"linha|evolucao|tendencia"),
    Rule("stacked", r"empilhad"),
)
FORMULA_RULES = (Rule("frequencia", r"frequencia"), Rule("gravidade", r"gravidade"), Rule("ruido", r"ruido|exposicao|decibe"))
#: Where a request says its column, its subject, its items and its text.
BY = r"\bpor\s+([a-z ]{3,25}?)(?=\s+(?:na|no|da|do|com|em)\b|[,.;!?]|$)"
SUBJECT = r"grafico(?:\s+de\s+(?:barras|pizza|linha|rosca|area|colunas)(?:\s+horizontais)?)?\s+(?:de|dos|das|com)\s+([a-z ]+?)\s+por\b"
NO_SUBJECT = r"^(pizza|barras?|linhas?|rosca|donut|area|colunas?|torta)(\s+horizontais)?$"
ITEMS = r"(?i)(?:itens|tarefas|com)\s*:?\s*(.+)$"
ITEM_BREAK = r"\s*[,;]\s*|\s+e\s+"
NOTE_TEXT = r"(?i)(?:dizendo|com o texto|escrito|texto|:)\s*[\"“]?(.+?)[\"”]?$"
KPI_VALUE = r"(?:valor|=|:|com)\s*(-?\d+(?:[.,]\d+)?)"
FORMULA = r"(?i)f[oó]rmula\s*[:=]?\s*(.+)$"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))


def widget(text: Column, as_of: Column) -> Column:
    """struct(type, kind, by, subject, since, value, max, items, text, pairs, url, formula) of a request.

    A request that names no widget, null too, asks for a chart, in bars unless it says
    otherwise. ``by`` is the column to group by, ``pairs`` are data in the request itself.
    """
    named = lambda t: F.struct(
        F.when(t == "", "chart").otherwise(first_of(t, WIDGET_RULES, "chart")).alias("type"),
        F.when(t == "", "bar").otherwise(first_of(t, CHART_RULES, "bar")).alias("kind"),
        _first(t, BY).alias("by"),
        _first(t, SUBJECT).alias("subject"),
        first_of(t, FORMULA_RULES, "").alias("formula"),
    )
    # the normal form, and what rules and patterns find in it, is made once
    return let(let(norm(text), named), lambda s: _widget(F.coalesce(text, F.lit("")), s["type"], s["kind"], s["by"], s["subject"], s["formula"], as_of))


def _widget(raw: Column, type_: Column, kind: Column, by: Column, subject: Column, formula: Column, as_of: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(raw, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), parse_number)
    only = lambda kinds, value: F.when(type_.isin(*kinds), value)
    value = F.when(type_ == "kpi", parse_number(_first(raw, KPI_VALUE))).when((type_ == "progress") & (F.size(numbers) > 1), F.array_min(numbers)).when(type_ == "progress", F.lit(0.0))
    most = only(("progress",), F.coalesce(F.array_max(numbers), F.lit(100.0)))
    items = F.filter(F.transform(F.split(_first(raw, ITEMS), ITEM_BREAK), lambda x: F.trim(F.regexp_replace(x, r"^itens\s*:?\s*", ""))), lambda x: x != "")
    subject = F.when(~subject.rlike(NO_SUBJECT), subject)
    kind = F.when((kind == "bar") & by.rlike(r"mes|data|periodo"), "line").otherwise(kind)
    return F.struct(
        type_.alias("type"),
        only(("chart",), kind).alias("kind"),
        only(("chart",), by).alias("by"),
        only(("chart",), subject).alias("subject"),
        only(("counter",), parse_date(_first(raw, r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})"), as_of)).alias("since"),
        value.cast("double").alias("value"),
        most.cast("double").alias("max"),
        only(("checklist",), items).alias("items"),
        only(("note",), _first(raw, NOTE_TEXT)).alias("text"),
        only(("chart",), pairs(raw)).alias("pairs"),
        only(("site", "links"), url(raw)).alias("url"),
        only(("calc",), F.coalesce(_first(raw, FORMULA), formula)).alias("formula"),
    )
