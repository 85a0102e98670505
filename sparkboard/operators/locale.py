"""Text order, groups and joins by the rules of a language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collated(c: Column, language: str = "pt", accents: bool = True, case: bool = True) -> Column:
    """``c`` under the collation of a language; without ``accents`` or ``case`` texts that differ in them alone are equal."""
    return F.collate(c, language + ("" if case else "_CI") + ("" if accents else "_AI"))


def sorted_by(df: DataFrame, column: str, language: str = "pt", descending: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """``df`` in the language's order of a text column, nulls last; then by ``ties``, so equal texts have an order too."""
    key = collated(F.col(f"`{column}`").cast("string"), language)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *[F.col(f"`{t}`") for t in ties])


def groups(df: DataFrame, column: str, aggregates: dict[str, Column], language: str = "pt", accents: bool = False, case: bool = False) -> DataFrame:
    """A row for each text that the collation tells apart: ``column`` as its first spelling in UTF-8 order, and ``aggregates``.

    Null is a group. The key of the shuffle is the collation's own, so spellings meet in one task after a map-side aggregation.
    """
    text = F.col(f"`{column}`").cast("string")
    key = collated(text, language, accents, case)
    return df.groupBy(key.alias("key_")).agg(F.min(text).alias(column), *[a.alias(n) for n, a in aggregates.items()]).drop("key_")


def joined(left: DataFrame, right: DataFrame, left_on: str, right_on: str, language: str = "pt", accents: bool = False, case: bool = False, kind: str = "inner") -> DataFrame:
    """Rows whose texts are equal under the collation; nulls meet nothing."""
    same = collated(left[left_on].cast("string"), language, accents, case) == collated(right[right_on].cast("string"), language, accents, case)
    return left.join(right, same, kind)
