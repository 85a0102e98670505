"""Lenient pt-BR dates, expiry status and calendar buckets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, norm

MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro".split()
SHORT_MONTHS = "jan fev mar abr mai jun jul ago set out nov dez".split()


def _checked(year: Column, month: Column, day: Column) -> Column:
    """A date of the years 1900 to 2200; null if there is none such."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    made = let(F.try_to_date(text, "yyyy-MM-dd"), lambda d: F.when(F.year(d).between(1900, 2200), d))
    return F.when(F.length(year) <= 4, made)


def parse_date(c: Column, as_of: Column) -> Column:
    """A date as people write it: hoje, amanhã, ontem; 2026-09-30 anywhere; 30/09/2026 with
    / . or -, two-digit years meaning 20xx; 30 de setembro [de 2026]; 30/09 in the year of
    ``as_of``. The first form that matches decides; null if it names no date."""
    return let(norm(c), lambda t: _read(t, as_of))


def _read(t: Column, as_of: Column) -> Column:
    part = lambda form, k: F.regexp_extract(t, form, k)
    iso, full = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})\b"
    named, short = rf"\b(\d{{1,2}})\s*(?:de\s+)?({'|'.join(MONTHS)})(?:\s*(?:de\s+)?(\d{{4}}))?", r"\b(\d{1,2})[/.\-](\d{1,2})\b"
    this = F.year(as_of).cast("string")
    y = part(full, 3)
    year = F.when(F.length(y) <= 2, F.concat(F.lit("20"), F.lpad(y, 2, "0"))).otherwise(y)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(named, 2)).cast("string")
    day = as_of.cast("date")
    return (
        F.when(t.rlike(r"^hoje\b"), day)
        .when(t.rlike(r"^amanha\b"), F.date_add(day, 1))
        .when(t.rlike(r"^ontem\b"), F.date_add(day, -1))
        .when(t.rlike(iso), _checked(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(full), _checked(year, part(full, 2), part(full, 1)))
        .when(t.rlike(named), _checked(F.coalesce(F.nullif(part(named, 3), F.lit("")), this), month, part(named, 1)))
        .when(t.rlike(short), _checked(this, part(short, 2), part(short, 1)))
    )


def date(c: Column, kind: str, as_of: Column) -> Column:
    """``c`` as a date: typed columns bypass the parser."""
    return c.cast("date") if kind in ("date", "timestamp", "timestamp_ntz") else parse_date(c, as_of)


def excel_date(c: Column) -> Column:
    """The date of a spreadsheet's day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c + 0.5).cast("int"))


def validity(d: Column, as_of: Column) -> Column:
    """vencido before ``as_of``, a_vencer up to 30 days on, em_dia beyond, sem_data if null."""
    days = F.datediff(d, as_of)
    return F.when(d.isNull(), F.lit("sem_data")).when(days < 0, "vencido").when(days <= 30, "a_vencer").otherwise("em_dia")


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_label(d: Column) -> Column:
    """mmm/yy in Portuguese."""
    return F.concat(F.element_at(F.array(*[F.lit(m) for m in SHORT_MONTHS]), F.month(d)), F.lit("/"), F.date_format(d, "yy"))


def long_date(d: Column) -> Column:
    names = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), F.element_at(F.array(*[F.lit(m) for m in names]), F.month(d)), F.lit(" de "), F.year(d).cast("string"))


def short_date(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def recency(d: Column, as_of: Column, pinned: Column | None = None) -> Column:
    """Fixadas, Hoje, Ontem, Últimos 7 dias, Mais antigas."""
    days = F.datediff(as_of, d)
    by_day = F.when(days <= 0, "Hoje").when(days == 1, "Ontem").when(days <= 7, "Últimos 7 dias").otherwise("Mais antigas")
    return by_day if pinned is None else F.when(pinned, F.lit("Fixadas")).otherwise(by_day)


def greeting(at: Column) -> Column:
    h = F.hour(at)
    return F.when((h < 5) | (h >= 18), "Boa noite").when(h < 12, "Bom dia").otherwise("Boa tarde")


def due_soon(d: Column, as_of: Column, before: int = 3, after: int = 45) -> Column:
    """Whether a reminder is within its window around ``as_of``."""
    return F.datediff(d, as_of).between(-before, after)
