"""Lenient pt-BR numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_FORM = r"(?i)^(-?[\d.,]+)(mil|mi|milh(?:oes|ões|ao|ão)|bi|bilh(?:oes|ões|ao|ão)|k|m)?$"


def parse_number(c: Column) -> Column:
    """A number as people write it: R$, spaces, a percent sign, thousands and decimals in
    either style, and the words mil, mi, bi. Null if it is none. One separator with three
    digits behind it is a thousands separator, but for a leading ``0.``."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"(?i)^R\$\s*", ""), r"\s", ""), "%$", "")
    # only what reads as digits with one point is cast: try_cast would take 1e3 and NaN too
    value = lambda x: let(F.regexp_extract(x, _FORM, 1), lambda digits: let(_plain(digits), lambda plain: F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))))
    times = lambda x: let(F.lower(F.regexp_extract(x, _FORM, 2)), lambda word: F.when(word.isin("mil", "k"), 1e3).when(word.startswith("mi") | (word == "m"), 1e6).when(word.startswith("bi"), 1e9).otherwise(1.0))
    return let(bare, lambda x: value(x) * times(x))


def _plain(digits: Column) -> Column:
    """Digits and separators as a plain decimal."""
    dots, commas = F.regexp_count(digits, F.lit(r"\.")), F.regexp_count(digits, F.lit(","))
    without = lambda sign: F.replace(digits, F.lit(sign), F.lit(""))
    return (
        F.when((dots > 0) & (commas > 0), F.when(F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), "."), F.replace(without("."), F.lit(","), F.lit("."))).otherwise(without(",")))
        .when(commas > 0, F.when((commas > 1) | digits.rlike(r",\d{3}$"), without(",")).otherwise(F.replace(digits, F.lit(","), F.lit("."))))
        .when(dots > 0, F.when((dots > 1) | (digits.rlike(r"\.\d{3}$") & ~digits.rlike(r"^-?0\.")), without(".")).otherwise(digits))
        .otherwise(digits)
    )


def number(c: Column, kind: str) -> Column:
    """``c`` as a double: typed columns bypass the parser."""
    return c.cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else parse_number(c)


def format_number(c: Column, decimals: int) -> Column:
    """1.234,56 with a fixed number of decimals."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def format_compact(c: Column) -> Column:
    """Short form with bi, mi and mil."""
    size = F.abs(c)
    return (
        F.when(size >= 1e9, F.concat(format_number(c / 1e9, 1), F.lit(" bi")))
        .when(size >= 1e6, F.concat(format_number(c / 1e6, 1), F.lit(" mi")))
        .when(size >= 1e4, F.concat(format_number(c / 1e3, 1), F.lit(" mil")))
        .when(c == F.floor(c), format_number(c, 0))
        .when(size < 10, format_number(c, 2))
        .otherwise(format_number(c, 1))
    )


def human_size(c: Column) -> Column:
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, F.concat(F.format_number(F.floor(c / 1024 + 0.5), 0), F.lit(" KB"))).otherwise(F.concat(format_number(c / 1048576, 1), F.lit(" MB")))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def column_name(index: int) -> str:
    """Spreadsheet letters of a column, counted from 0."""
    name = ""
    index += 1
    while index:
        index, r = divmod(index - 1, 26)
        name = chr(65 + r) + name
    return name


def column_index(reference: str) -> int:
    """Column, counted from 0, of a cell reference such as AB12."""
    n = 0
    for ch in reference.upper():
        if not ch.isalpha():
            break
        n = 26 * n + ord(ch) - 64
    return n - 1


def nice_ticks(low: float, high: float, wanted: int = 5, integer: bool = False) -> list[float]:
    """Axis ticks whose step is 1, 2, 2.5, 5 or 10 times a power of ten."""
    import math

    span = (high - low) or abs(high) or 1.0
    raw = span / max(1, wanted)
    power = 10.0 ** math.floor(math.log10(raw))
    steps = [s * power for s in (1, 2, 2.5, 5, 10) if not integer or (s * power >= 1 and float(s * power).is_integer())] or [1.0]
    step = next((s for s in steps if s >= raw * (1 - 1e-12)), steps[-1])
    first, last = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [round(k * step, 10) for k in range(first, last + 1)]
