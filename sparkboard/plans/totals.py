"""Subtotals and cross tables over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import BLANK, column_name
from .spec import SpecError

TOTAL = "Total"


def _labels(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with its key columns as shown: trimmed text, blanks named."""
    shown = {k: F.coalesce(F.nullif(F.trim(F.col(f"`{column_name(df, k)}`").cast("string")), F.lit("")), F.lit(BLANK)) for k in keys}
    return df.withColumns(shown)


def with_totals(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], sets: str | Sequence[Sequence[str]] = "rollup") -> DataFrame:
    """``keys`` as labels, ``level`` and ``aggregates`` for each group and each total.

    ``sets``: "rollup" (each prefix of the keys), "cube" (each subset), or the sets themselves. What a
    total runs over says "Total"; ``level`` is the grouping id: a bit for each key that is summed over, the first key the
    highest, so 0 is a plain group, and a blank group stays apart from a total. The rows are expanded once for
    each set before a map-side aggregation. An empty table has no groups and no totals.
    """
    rows, names = _labels(df, keys), [f"`{k}`" for k in keys]
    if isinstance(sets, str):
        if sets not in ("rollup", "cube"):
            raise SpecError(f"no sets {sets!r}")
        grouped = rows.rollup(*names) if sets == "rollup" else rows.cube(*names)
    else:
        unknown = {k for s in sets for k in s} - set(keys)
        if unknown:
            raise SpecError(f"sets over {sorted(unknown)}, which are no keys")
        grouped = rows.groupingSets([[F.col(f"`{k}`") for k in s] for s in sets], *[F.col(n) for n in names])
    summed = [F.grouping(n).alias(f"total_{k}") for k, n in enumerate(names)]
    out = grouped.agg(F.grouping_id().cast("long").alias("level"), *summed, *[a.alias(n) for n, a in aggregates.items()])
    shown = [F.when(F.col(f"total_{k}") == 1, F.lit(TOTAL)).otherwise(F.col(n)).alias(keys[k]) for k, n in enumerate(names)]
    return out.select(*shown, "level", *[F.col(f"`{a}`") for a in aggregates])


def pivoted(df: DataFrame, key: str, across: str, value: Column, aggregate=F.sum, values: Sequence[str] | None = None, most: int = 100) -> DataFrame:
    """A row for each label of ``key`` and a column for each label of ``across``, in order, then ``Total``.

    Values are found by one job if they are not given; more than ``most`` of them are an error, for no column is
    left out unsaid. One pass then aggregates all columns. A cell without rows is null.
    """
    rows = _labels(df, [key, across])
    if values is None:
        found = rows.select(F.col(f"`{across}`").alias("v")).distinct().orderBy("v").limit(most + 1).collect()  # at most ``most`` + 1 rows
        if len(found) > most:
            raise SpecError(f"{across} has more than {most} values")
        values = [r.v for r in found]
    cells = [aggregate(F.when(F.col(f"`{across}`") == v, value)).alias(v) for v in values]
    return rows.groupBy(F.col(f"`{key}`").alias(key)).agg(*cells, aggregate(value).alias(TOTAL))
