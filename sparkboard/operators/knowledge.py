"""Search in a knowledge base held as tables: activities by their terms, norms by subject, glossary entries.

The knowledge base is data: activities (activity, name, terms), hints (term, activities),
norms (number, title, keywords, summary), glossary (term, aliases, definition). Texts are
the large side; terms meet them by equality joins on word n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from . import retrieval


def plain(c: Column) -> Column:
    """The normal form with letters and digits only, one space between words."""
    return F.trim(F.regexp_replace(norm(c), "[^a-z0-9]+", " "))


def _with_grams(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with w, the words of t, and one row for each distinct gram: runs of as many words as a term has."""
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1  # a number of the knowledge base, which is small
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    runs = [F.col("w") if n == 1 else run(n) for n in range(1, longest + 1)]
    return rows.withColumn("w", F.split("t", " ")).withColumn("gram", F.explode(F.array_distinct(F.concat(*runs))))


def activity_terms(activities: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(term, activity, score) of a knowledge base: a term scores its length, four more if it
    has several words, and long terms count in the plural too; a name scores 40; a hint
    scores 9, 6, 3 and so on for its activities in order."""
    term = activities.select("activity", F.explode("terms").alias("t")).select("activity", plain(F.col("t")).alias("term"))
    score = F.length("term") + F.when(F.contains("term", F.lit(" ")), 4).otherwise(0)
    own = term.select("activity", "term", score.alias("score"))
    many = own.where(F.length("term") > 3).select("activity", F.concat("term", F.lit("s")).alias("term"), "score")
    every = own.union(many).union(activities.select("activity", plain(F.col("name")).alias("term"), F.lit(40).alias("score")))
    if hints is not None:
        hinted = hints.select(plain(F.col("term")).alias("term"), F.posexplode("activities").alias("k", "activity"))
        every = every.union(hinted.select("activity", "term", (9 - 3 * F.col("k")).alias("score")))
    return every.groupBy("term", "activity").agg(F.max("score").alias("score"))


def _stated(terms: DataFrame) -> DataFrame:
    """``terms``, to be sent to the texts where they are few enough."""
    return F.broadcast(terms) if retrieval.small(terms) else terms


def _near_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, activity, score) of long single words with a typing error: one edit, two from nine letters on."""
    near = terms.where(~F.contains("term", F.lit(" ")) & (F.length("term") >= 6)).select("term", "activity", F.when(F.length("term") >= 9, 2).otherwise(1).alias("most"), F.substring("term", 1, 1).alias("letter"), F.length("term").alias("size"))
    keyed = words.withColumn("letter", F.substring("word", 1, 1)).withColumn("size", F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)))
    d = F.levenshtein("word", "term", 2)
    return keyed.join(_stated(near), ["letter", "size"]).where((d >= 0) & (d <= F.col("most"))).select("doc", "activity", F.lit(6).alias("score")).distinct()


def find_activities(docs: DataFrame, doc: str, text: str, activities: DataFrame, hints: DataFrame | None = None, implied: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(doc, rank, activity, score): the ``most`` best activities of each text.

    Where no term is found, long words with a typing error count. ``implied`` (activity,
    contains) takes out what another found activity contains. After the best, an
    activity needs half its score, or 6 if that is less. Ties fall to the first name.
    """
    terms = activity_terms(activities, hints)
    rows = docs.select(F.col(doc).alias("doc"), plain(F.col(text)).alias("t"))
    exact = _with_grams(rows, terms).select("doc", F.col("gram").alias("term")).join(_stated(terms), "term").groupBy("doc", "activity").agg(F.max("score").alias("score"))
    words = rows.select("doc", F.explode(F.filter(F.array_distinct(F.split("t", " ")), lambda w: F.length(w) >= 6)).alias("word"))
    found = exact.union(_near_terms(words, terms).join(exact.select("doc"), "doc", "left_anti"))  # what was found is dealt by document, texts are not
    if implied is not None:
        inner = found.select("doc", "activity").join(implied, "activity").select("doc", F.col("contains").alias("activity"))
        found = found.join(inner, ["doc", "activity"], "left_anti")
    order = Window.partitionBy("doc").orderBy(F.desc("score"), F.asc("activity"))
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy("doc")))
    kept = ranked.where((F.col("rank") == 1) | (F.col("score") >= F.least(F.lit(6.0), F.col("top") * 0.5))).where(F.col("rank") <= most)
    return kept.select("doc", "rank", "activity", "score")


def search_norms(queries: DataFrame, query: str, text: str, norms: DataFrame, k: int = 3) -> DataFrame:
    """(query, doc, score, coverage, rank): norms by BM25 over title (twice), keywords and summary; revoked ones stay out."""
    valid = norms.where(~F.coalesce("revoked", F.lit(False))).select("number", F.concat_ws(" ", "title", "title", "keywords", "summary").alias("t"))
    return retrieval.bm25(retrieval.build_index(valid, "number", "t"), queries, query, text, k=k)


def find_glossary(docs: DataFrame, doc: str, text: str, glossary: DataFrame) -> DataFrame:
    """(doc, term, definition): the entry whose longest name stands in the text; names of three
    letters or fewer count in texts of up to six words only."""
    names = glossary.select("term", "definition", F.explode(F.concat(F.array("term"), F.split(F.coalesce("aliases", F.lit("")), ","))).alias("n")).select("term", "definition", plain(F.col("n")).alias("gram")).where("gram <> ''")
    rows = docs.select(F.col(doc).alias("doc"), plain(F.col(text)).alias("t")).withColumn("n_words", F.size(F.split("t", " ")))
    hits = _with_grams(rows, names.select(F.col("gram").alias("term"))).select("doc", "n_words", "gram").join(_stated(names), "gram").where((F.length("gram") > 3) | (F.col("n_words") <= 6))
    best = hits.groupBy("doc").agg(F.max(F.struct(F.length("gram").alias("n"), "gram", "term", "definition")).alias("b"))
    return best.select("doc", "b.term", "b.definition")
