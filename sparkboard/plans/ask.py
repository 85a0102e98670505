"""Requests in words that end in rules: names find their dataset and column, and one request may hold several changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dice, norm
from ..scratch import written
from . import request
from .edit import edit

#: How near a word is to a column's name to mean it, and what a common beginning adds.
LEAST, BEGINNING, LETTERS = 0.5, 0.25, 4


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def columns_named(asked: DataFrame, word: str, catalog: DataFrame) -> DataFrame:
    """word, dataset, column, type and score: of each distinct word the column that it means, if any is near enough.

    ``catalog`` has dataset, column, type and position, a row for each column. The score is the Dice similarity of bigrams, more where
    the first letters agree; ties fall to the smaller position. A word meets only columns it shares a bigram with, and each
    distinct word once, however many requests say it. Null and empty words mean nothing.
    """
    words = asked.select(F.col(f"`{word}`").alias("word")).where("word <> ''").distinct()
    left = words.withColumn("g", F.explode(_grams(norm(F.col("word")))))
    right = catalog.withColumn("g", F.explode(_grams(norm(F.col("column")))))
    pairs = left.join(right, "g").select("word", "dataset", "column", "type", "position").distinct()
    begins = F.startswith(norm(F.col("column")), F.substring(norm(F.col("word")), 1, LETTERS))
    scored = pairs.withColumn("score", dice(F.col("word"), F.col("column")) + F.when(begins, BEGINNING).otherwise(0.0)).where(F.col("score") >= LEAST)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "position", "dataset", "column"))
    return scored.withColumn("r", rank).where("r = 1").drop("r", "position")


def charts_asked(requests: DataFrame, key: str, text: str, catalog: DataFrame, as_of: Column) -> DataFrame:
    """``key``, dataset, x, y, agg, kind and group_date for every request for a chart: a rule that ``resolve.chart`` takes.

    x is the column that the word after "por" means, y the one that the subject means if it is a number of the same
    dataset; then its values are summed, else rows are counted. A date is grouped by month, as a line unless another
    kind is asked for. Where no column is meant, dataset and x are null: the request is answered with a question.
    """
    # each distinct request is read once; what it says is a table, which both lookups and the answer read
    texts = requests.select(F.col(f"`{text}`").alias("text")).distinct().select("text", request.widget(F.col("text"), as_of).alias("w"))
    read = written(texts.select("text", "w.type", "w.kind", F.trim("w.by").alias("by"), F.trim("w.subject").alias("subject")), "requests").where("type = 'chart'")
    rows = requests.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("said"))
    said = rows.join(read, F.col("said").eqNullSafe(F.col("text"))).select("key", "kind", "by", "subject")
    found = columns_named(read.select(F.explode(F.array("by", "subject")).alias("word")), "word", catalog)
    x = found.select(F.col("word").alias("by"), "dataset", F.col("column").alias("x"), F.col("type").alias("x_type"))
    y = found.where("type = 'number'").select(F.col("word").alias("subject"), F.col("dataset").alias("y_dataset"), F.col("column").alias("y"))
    both = said.join(x, "by", "left").join(y, "subject", "left")
    same = F.coalesce(F.col("dataset") == F.col("y_dataset"), F.lit(False))
    dated = F.coalesce(F.col("x_type") == "date", F.lit(False))
    return both.select(
        F.col("key").alias(key),
        "dataset",
        "x",
        F.when(same, F.col("y")).alias("y"),
        F.when(same, "sum").otherwise("count").alias("agg"),
        F.when(dated & (F.col("kind") == "bar"), "line").otherwise(F.col("kind")).alias("kind"),
        F.when(dated, "month").alias("group_date"),
    )


def changes_asked(requests: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, step and the columns of ``edit.edit`` for each change of each request: changes are parted by semicolons, line feeds or "e depois".

    Parts that ask for no change are left out, but steps keep their number; a null request has none.
    """
    parts = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"(?i)\s*(?:;|\n|,? e depois )\s*")
    rows = requests.select(F.col(f"`{key}`").alias(key), F.posexplode(parts).alias("step", "part"))
    return rows.select(key, "step", edit(F.col("part")).alias("e")).select(key, "step", "e.*").where("op <> 'none'")
