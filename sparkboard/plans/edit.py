"""Changes to a board asked for in words: one struct of columns for a table of requests.

The struct names the operation of ``plans.oplog`` and what it takes. Which widget or
sub-tab a name means is for ``operators.lookup.nearest_name`` to find; a request to add
a widget goes on to ``plans.request.widget``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clean_name, let, norm, split_list
from ..operators.classify import Rule, first_of

# The words, or their stems, that name blocks, changes and sub-tabs.
_BLOCK = r"(grafico|kpi|indicador|card|tabela|nota|checklist|contador|formulario|calculadora|links?|bloco|meta|progresso|widget)s?"
_ADD, _REMOVE, _CHANGE = r"(adicion|inclu|coloc|cri|insir|ponh|faz)\w*", r"(remov|exclu|apag|delet|tir)\w*", r"(mud|troc|transform|alter|convert)\w*"
_SUB = r"sub[ -]?abas?"

#: The first that is found decides; what names a sub-tab comes before what names its board.
EDIT_RULES = (
    Rule("add_subtab", rf"^{_ADD} (as? |umas? |mais |novas? )*{_SUB}\b"),
    Rule("rename_subtab", rf"^renome\w* (a )?{_SUB} .+ para "),
    Rule("remove_subtab", rf"^{_REMOVE} (a )?{_SUB}\b"),
    Rule("retitle_widget", rf"^renome\w* (o |a ){_BLOCK} .*para "),
    Rule("rename_tab", r"^(renome\w*|(mud|troc|alter)\w* o nome)\b.* para "),
    Rule("set_columns", r"\b[1-4] colunas?\b"),
    Rule("set_theme", r"(tema|modo|fundo) (escuro|claro|dark|light)"),
    Rule("set_color", r"\b(cor|pint\w*)\b.*#[0-9a-f]{6}"),
    Rule("set_description", r"(descricao|objetivo) ?[:-]"),
    Rule("set_kind", rf"{_CHANGE} (o )?grafico .*(para|em) .*(pizza|rosca|donut|barra|coluna|linha|area|empilhad)"),
    Rule("set_span", rf"\b(o|a) {_BLOCK} .*(maior|largura total|inteir[oa]|menor|pequen[oa]|metade)"),
    Rule("move_widget", rf"(mov|pass|lev|coloc)\w* (o |a ){_BLOCK} .*para "),
    Rule("remove_widget", rf"^{_REMOVE} (o |a |os |as |ess[ea] )?{_BLOCK}\b"),
    Rule("add_widget", rf"^{_ADD} .*{_BLOCK}\b"),
)
#: Words for kinds of charts.
KIND_RULES = (
    Rule("donut", r"(para|em) .*(pizza|rosca|donut)"),
    Rule("hbar", r"(para|em) .*barras? horizonta"),
    Rule("stacked", r"(para|em) .*empilhad"),
    Rule("area", r"(para|em) .*area"),
    Rule("line", r"(para|em) .*linha"),
)
#: Words for places, widths, themes, colours and descriptions.
TO_TOP, TO_END = r"para (o |a )?(topo|inicio|comeco|primeir)", r"para (o |a )?(fim|final|ultim)"
FULL, WIDER, HALF = "largura total|inteir", "maior", "metade"
DARK, COLOUR = r"(tema|modo|fundo) (escuro|dark)", "(#[0-9a-f]{6})"
DESCRIPTION = r"(?i)(?:descri[cç][aã]o|objetivo) ?[:-] ?(.+)$"


def _part(c: Column, pattern: str) -> Column:
    return F.nullif(clean_name(F.regexp_extract(c, pattern, 1)), F.lit(""))


def edit(text: Column) -> Column:
    """struct(op, target, names, value) of a request; op is ``none`` if it asks for no change, null too.

    ``target`` is the widget or sub-tab meant, ``names`` the sub-tabs to add, ``value`` the
    new name, colour, theme, kind, width (1 to 4), place (first, last or a sub-tab) or number.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    said = let(raw, lambda r: F.struct(r.alias("raw"), norm(r).alias("t")))
    op = lambda s: F.when(s["t"] == "", "none").otherwise(first_of(s["t"], EDIT_RULES, "none"))
    return let(said, lambda s: let(op(s), lambda o: _edit(s["raw"], s["t"], o)))  # the normal form and the operation are found once


def _edit(raw: Column, t: Column, op: Column) -> Column:
    new_name = _part(raw, r"(?i)^.* para [\"“']?(.+?)[\"”']?$")
    subtab = F.coalesce(_part(raw, r"(?i)sub[ -]?aba [\"“']?(.+?)[\"”']? para "), _part(raw, r"(?i)sub[ -]?aba [\"“']?(.+?)[\"”']?$"))
    block = r"(?i)\b(?:gr[aá]fico|kpi|indicador|card|tabela|nota|checklist|contador|formul[aá]rio|calculadora|links?|bloco|meta|progresso|widget)s?\b"
    named = _part(raw, block + r" ?(?:d[aeo]s? |sobre )?[\"“']?(.*?)[\"”']?(?: (?:para|em|maior|menor|inteir|metade|com largura|na aba|largura).*)?$")
    is_ = lambda *ops: op.isin(*ops)
    place = F.when(t.rlike(TO_TOP), "first").when(t.rlike(TO_END), "last").otherwise(F.coalesce(_part(raw, r"(?i)para a? ?sub[ -]?aba (.+)$"), new_name))
    width = F.when(t.rlike(FULL), "4").when(t.rlike(WIDER), "+1").when(t.rlike(HALF), "2").otherwise("1")
    value = (
        F.when(is_("rename_subtab", "rename_tab", "retitle_widget"), new_name)
        .when(is_("set_columns"), F.regexp_extract(t, r"\b([1-4]) colunas?\b", 1))
        .when(is_("set_theme"), F.when(t.rlike(DARK), "dark").otherwise("light"))
        .when(is_("set_color"), F.regexp_extract(t, COLOUR, 1))
        .when(is_("set_description"), _part(raw, DESCRIPTION))
        .when(is_("set_kind"), first_of(t, KIND_RULES, "bar"))
        .when(is_("set_span"), width)
        .when(is_("move_widget"), place)
    )
    asked = F.regexp_extract(raw, r"(?i)sub[ -]?abas?\s*(?:chamadas?|com o nome|de|para|:)?\s*(.*)$", 1)
    return F.struct(
        op.alias("op"),
        F.when(is_("rename_subtab", "remove_subtab"), subtab).when(is_("retitle_widget", "set_kind", "set_span", "move_widget", "remove_widget"), named).alias("target"),
        F.when(is_("add_subtab"), split_list(asked)).alias("names"),
        value.alias("value"),
    )
