"""Risk matrix, accident rates and noise dose as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permitted minutes a day by noise level in dB(A).
NOISE_MINUTES = {85: 480, 86: 420, 87: 360, 88: 300, 89: 270, 90: 240, 91: 210, 92: 180, 93: 160, 94: 135, 95: 120, 96: 105, 98: 75, 100: 60, 102: 45, 104: 35, 105: 30, 106: 25, 108: 20, 110: 15, 112: 10, 114: 8, 115: 7}


def risk_level(p: Column, s: Column) -> Column:
    """Crítico from 20, Alto from 10, Moderado from 5, else Baixo, of probability times severity."""
    score = p * s
    return F.when(score >= 20, "Crítico").when(score >= 10, "Alto").when(score >= 5, "Moderado").otherwise("Baixo")


def residual_probability(p: Column, s: Column) -> Column:
    """Lowered by two for severity 5 or more, else by one; 1 at least."""
    return F.greatest(F.lit(1), p - F.when(s >= 5, 2).otherwise(1))


def frequency_rate(accidents: Column, hours: Column) -> Column:
    return F.try_divide(accidents * 1e6, hours.cast("double"))


def severity_rate(days: Column, hours: Column) -> Column:
    return F.try_divide(days * 1e6, hours.cast("double"))


def noise_minutes(level: Column) -> Column:
    """From the table after rounding, else by formula; null (no limit) under 85."""
    at = F.floor(level + 0.5).cast("int")
    table = F.create_map(*[F.lit(x) for pair in NOISE_MINUTES.items() for x in pair])
    formula = F.floor(F.lit(480.0) / F.power(F.lit(2.0), (level - 85) / 5) + 0.5)
    return F.when(level < 85, F.lit(None)).otherwise(F.coalesce(F.try_element_at(table, at).cast("double"), formula.cast("double")))


def noise_dose(level: Column, minutes: Column) -> Column:
    """Per cent of the permitted time; 0 where there is no limit."""
    return F.coalesce(F.try_divide(minutes * 100.0, noise_minutes(level)), F.lit(0.0))
