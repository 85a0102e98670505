"""Lookups between tables and dictionaries: containment, nearest name, coverage, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dice, jaccard, norm, words
from ..scratch import written


def dictionary_hits(docs: DataFrame, doc: str, text: str, terms: DataFrame, term: str, longest: int = 4) -> DataFrame:
    """(doc, term, hits): whole-word occurrences of dictionary terms of up to ``longest``
    words, by an equality join on n-grams, so neither side need be small."""
    folded = terms.select(norm(F.col(term)).alias("gram"), F.col(term).alias("term"))
    tokens = docs.select(F.col(doc).alias("doc"), words(F.col(text)).alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    return tokens.select("doc", F.explode(grams).alias("gram")).join(folded, "gram").groupBy("doc", "term").agg(F.count("*").alias("hits"))


def nearest_name(names: DataFrame, name: str, candidates: DataFrame, candidate: str, least: float = 0.5) -> DataFrame:
    """(name, candidate, score): the candidate of highest bigram Dice, ties falling to the
    first in order, blocked on shared bigrams of the normal form."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    left = names.select(F.col(name).alias("name")).distinct().withColumn("g", F.explode(grams(norm(F.col("name")))))
    right = candidates.select(F.col(candidate).alias("candidate")).distinct().withColumn("g", F.explode(grams(norm(F.col("candidate")))))
    pairs = left.join(right, "g").select("name", "candidate").distinct().withColumn("score", dice(F.col("name"), F.col("candidate"))).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), F.asc("candidate")))
    return pairs.withColumn("r", rank).where("r = 1").drop("r")


def nearest_phrase(phrases: DataFrame, learned: DataFrame, least: float = 0.8, least_long: float = 0.66) -> DataFrame:
    """(phrase, learned, score): learned phrase of highest Jaccard over words: ``least``, or
    ``least_long`` from three words on. Candidates share a word."""
    left = phrases.select(F.col("phrase"), F.array_distinct(words(F.col("phrase"))).alias("a"))
    right = learned.select(F.col("phrase").alias("learned"), F.array_distinct(words(F.col("phrase"))).alias("b"))
    shared = left.withColumn("w", F.explode("a")).join(right.withColumn("w", F.explode("b")), "w").select("phrase", "learned", "a", "b").distinct()
    scored = shared.withColumn("score", jaccard(F.col("a"), F.col("b"))).where((F.col("score") >= least) | ((F.col("score") >= least_long) & (F.size("a") >= 3)))
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("score"), F.asc("learned")))
    return scored.withColumn("r", rank).where("r = 1").select("phrase", "learned", "score")


def covered(items: DataFrame, item: str, item_words: str, docs: DataFrame, doc: str, doc_words: str, least: float = 0.8) -> DataFrame:
    """(item, doc, coverage): documents that hold a share of ``least`` or more of an item's distinct words.

    Of an item's n words such a document misses n - ceil(least n) at most, so it holds
    one of any n - ceil(least n) + 1 of them: candidates meet on that many of the item's
    rarest words, and common words pair nothing.
    """
    tokens = items.select(F.col(item).alias("item"), F.array_distinct(item_words).alias("a")).select("item", F.size("a").alias("n"), F.explode("a").alias("token"))
    each = docs.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(doc_words)).alias("token"))
    # texts are read once: what documents hold of the items' words is a table, read three times
    held = written(each.join(tokens.select("token").distinct(), "token", "left_semi"), "held")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), F.asc("token")))
    most = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    ranked = written(tokens.join(df, "token", "left").withColumn("r", rank).select("item", "n", "token", (F.col("r") <= most).alias("rare")), "ranked")
    pairs = ranked.where("rare").select("item", "token").join(held, "token").select("item", "doc").distinct()
    hits = pairs.join(ranked.select("item", "n", "token"), "item").join(held, ["doc", "token"])
    share = F.count("*") / F.first("n")
    return hits.groupBy("item", "doc").agg(share.alias("coverage")).where(F.col("coverage") >= least)


def with_lookup(df: DataFrame, table: DataFrame, on: list[str], default: dict[str, Column] | None = None) -> DataFrame:
    """Left lookup with fall-backs; whether the table is broadcast is for adaptive execution to say, by its size."""
    out = df.join(table, on, "left")
    for name, value in (default or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def as_of_page(offsets: DataFrame, breaks: DataFrame, doc: str) -> DataFrame:
    """(doc, offset, page): one more than the page breaks at or before the offset, without a range join:
    breaks and offsets of a document are merged in order and counted."""
    both = offsets.select(doc, F.col("offset"), F.lit(1).alias("kind")).unionByName(breaks.select(doc, F.col("offset"), F.lit(0).alias("kind")))
    before = Window.partitionBy(doc).orderBy("offset", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("page", F.sum(1 - F.col("kind")).over(before) + 1).where("kind = 1").drop("kind")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in business order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def merged_arrays(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """Distinct union of array columns over the rows of a key."""
    return df.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias(a) for a in arrays])
