"""What conversations leave behind: facts to recall and to forget, answers that were disliked, preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, words
from .retrieval import bm25, build_index, written_index

LATEST_NEGATIVES = 200  # fixed value: how many disliked answers are remembered


def recalled(facts: DataFrame, fact: str, text: str, asked: DataFrame, query: str, wanted: str, k: int = 3, least: float = 0.34) -> DataFrame:
    """(query, doc, score, coverage): of the ``k`` best facts for each request, those that
    cover ``least`` of its terms."""
    return bm25(written_index(build_index(facts, fact, text)), asked, query, wanted, k=k, many=True).where(F.col("coverage") >= least)


def forgotten(facts: DataFrame, fact: str, text: str, asked: DataFrame, query: str, wanted: str) -> DataFrame:
    """The facts that stay once each request has taken the facts that cover half of it, five at most."""
    gone = recalled(facts, fact, text, asked, query, wanted, k=5, least=0.5).select(F.col("doc").alias(fact)).distinct()
    return facts.join(gone, fact, "left_anti")


def disliked(answers: DataFrame, negatives: DataFrame, most: int = LATEST_NEGATIVES, least: float = 0.8) -> DataFrame:
    """Rows of ``answers`` (intent, text, …) like one of the ``most`` latest negatives (intent,
    text, at) of the same intent. Only that many negatives are ever broadcast."""
    latest = negatives.orderBy(F.desc("at"), F.asc("text"), F.asc("intent")).limit(most)
    set_of = lambda c: F.array_distinct(words(F.col(c)))
    bad = latest.select(F.col("intent").alias("_intent"), set_of("text").alias("_bad")).distinct()
    own = answers.withColumn("_own", set_of("text"))  # read once for a row, not once for each pair
    a, b = F.size("_own"), F.size("_bad")
    like = let(F.size(F.array_intersect("_own", "_bad")), lambda n: n / (a + b - n) > least)
    # sets alike by more than ``least`` are of like sizes; others are not compared
    found = own.join(F.broadcast(bad), (F.col("intent") == F.col("_intent")) & (F.least(a, b) > least * F.greatest(a, b) - 1e-9) & (a + b > 0) & like, "left_semi")
    return found.drop("_own")


def preferred(uses: DataFrame, user: str, value: str, least: int = 2) -> DataFrame:
    """(user, value, n): the commonest value of each user, if used ``least`` times; ties by name."""
    counts = uses.where(F.col(value).isNotNull()).groupBy(user, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(user).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.where(F.col("b.n") <= -least).select(user, F.col("b.v").alias(value), (-F.col("b.n")).alias("n"))


def preferred_detail(uses: DataFrame, user: str, detail: str, short: str = "resumido", full: str = "completo") -> DataFrame:
    """(user, detail): short or full if asked for three times and over 1.5 times as often as the other."""
    n = uses.groupBy(user).agg(F.count_if(F.col(detail) == short).alias("s"), F.count_if(F.col(detail) == full).alias("f"))
    s, f = F.col("s"), F.col("f")
    return n.select(user, F.when((s >= 3) & (s > f * 1.5), short).when((f >= 3) & (f > s * 1.5), full).alias(detail))
