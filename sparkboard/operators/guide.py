"""One search over all that a knowledge base holds, advice by trigger, and titles of conversations.

Questions are the large side. The knowledge base comes as tables and is met by an
equality join on words, so its postings are broadcast where they are small and
shuffled where they are not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalised, norm, truncated
from ..scratch import written
from . import retrieval
from .classify import Rule

#: A best entry answers from these on.
LEAST_SCORE, LEAST_COVERAGE = 2.2, 0.4
#: Titles of conversations by intent.
TITLES = {
    "site_read": "Leitura de site",
    "recall_chats": "Busca nas conversas",
    "recall_profile": "Memória",
    "remember": "Memória",
    "forget": "Memória",
    "calc": "Cálculo de SST",
}
ABOUT_FILES = "^(doc_|file_only|photo_report|image_ocr)"


def entries(norms: DataFrame | None = None, glossary: DataFrame | None = None, activities: DataFrame | None = None, advice: DataFrame | None = None, label: str = "NR-") -> DataFrame:
    """(entry, kind, id, t): what there is to be found, one row each.

    norms (number, title, summary, keywords), glossary (term, aliases, definition),
    activities (activity, name, terms) and advice (advice, title, steps), where terms and
    steps are arrays. A null cell is left out of the text; ``entry`` is kind and id.
    """
    parts = []
    if norms is not None:
        parts.append(norms.select(F.lit("norm").alias("kind"), F.col("number").cast("string").alias("id"), F.concat_ws(" ", F.concat(F.lit(label), F.col("number").cast("string")), "title", "summary", "keywords").alias("t")))
    if glossary is not None:
        parts.append(glossary.select(F.lit("glossary").alias("kind"), F.col("term").alias("id"), F.concat_ws(" ", "term", "aliases", "definition").alias("t")))
    if activities is not None:
        parts.append(activities.select(F.lit("activity").alias("kind"), F.col("activity").cast("string").alias("id"), F.concat_ws(" ", "name", "terms").alias("t")))
    if advice is not None:
        parts.append(advice.select(F.lit("advice").alias("kind"), F.col("advice").cast("string").alias("id"), F.concat_ws(" ", "title", "steps").alias("t")))
    if not parts:
        raise ValueError("no table of the knowledge base is given")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select(F.concat_ws(":", "kind", "id").alias("entry"), "kind", "id", "t")


def found(questions: DataFrame, question: str, text: str, known: DataFrame, k: int = 3, fuzzy: bool = True, stems: bool = True) -> DataFrame:
    """(question, rank, kind, id, score, coverage): the k best entries by BM25; scores equal to nine digits fall to the first entry."""
    known = written(known, "known")
    index = retrieval.written_index(retrieval.build_index(known, "entry", "t", stems))
    # rows that share an id are one question; questions of one text are answered once
    said = F.array_join(F.array_sort(F.collect_set(text)), " ").alias("said")
    asked = questions.where(F.col(question).isNotNull()).groupBy(F.col(question).alias("question")).agg(said)
    asked = written(asked.withColumn("same", F.sha2("said", 256)), "asked")
    texts = asked.groupBy("same").agg(F.min("said").alias("said"))
    scored = retrieval.bm25(index, texts, "same", "said", k=None, fuzzy=fuzzy, stems=stems, many=True).withColumnRenamed("query", "same")
    rank = F.row_number().over(Window.partitionBy("same").orderBy(F.desc(F.round("score", 9)), F.asc("doc")))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= k).join(known.select(F.col("entry").alias("doc"), "kind", "id"), "doc")
    return asked.select("question", "same").join(best, "same").select("question", "rank", "kind", "id", "score", "coverage")


def answers(questions: DataFrame, question: str, text: str, known: DataFrame, fuzzy: bool = True, stems: bool = True) -> DataFrame:
    """(question, kind, id, score, coverage): the best entry of each question if it scores more than
    ``LEAST_SCORE`` and covers ``LEAST_COVERAGE`` of the question's words, else nulls.

    One row for each distinct id of a question; rows that share an id are one question.
    Null and empty texts, and a null id, have nulls; an empty knowledge base answers nothing.
    """
    best = found(questions, question, text, known, 1, fuzzy, stems).where((F.col("score") > LEAST_SCORE) & (F.col("coverage") >= LEAST_COVERAGE)).drop("rank")
    return questions.select(F.col(question).alias("question")).distinct().join(best, "question", "left")


def advice_for(text: Column, rules: Sequence[Rule]) -> Column:
    """The first advice whose trigger matches the normal form of ``text``; null if none does."""
    t = norm(text)
    return F.coalesce(*[F.when(t.rlike(rule.pattern), rule.result) for rule in rules], F.lit(None).cast("string"))


def titles(chats: DataFrame, chat: str, text: str, slots: Mapping[str, Column] | None = None) -> DataFrame:
    """(chat, title) of each conversation, from what its first request was understood as.

    ``slots`` are columns of ``chats``: intent, document (the label of one to be made),
    activity, norm (a number), norm_title, advice (its title) and term; one that is missing
    is null. A document names itself and its activity, then the intent decides, then the
    text's three weightiest words, then its beginning. ``chat`` is a key; an empty text
    without slots has an empty title.
    """
    of = lambda name: (slots or {}).get(name, F.lit(None).cast("string"))
    intent, number = of("intent"), of("norm").cast("string")
    said = F.coalesce(F.col(text), F.lit(""))
    by_intent = None
    for name, title in TITLES.items():
        by_intent = F.when(intent == name, title) if by_intent is None else by_intent.when(intent == name, title)
    title = F.coalesce(
        F.when(of("document").isNotNull(), F.concat_ws(" — ", of("document"), of("activity"))),
        F.when((intent == "nr_info") & number.isNotNull(), F.substring(F.concat(F.lit("NR-"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit(" — "), F.coalesce(of("norm_title"), F.lit(""))), 1, 60)),
        F.when(intent.startswith("tab_"), F.concat(F.lit("Abas — "), truncated(said, 40))),
        by_intent,
        F.when(intent.rlike(ABOUT_FILES), "Análise de arquivo"),
        F.when(intent == "advice", of("advice")),
        F.when(intent == "define", F.concat(F.lit("O que é "), of("term"))),
    )
    rows = chats.select(F.col(chat).alias("chat"), said.alias("said"), title.alias("title"))
    weighty = retrieval.keywords(rows.where("title IS NULL"), "chat", "said", 3)
    names = weighty.groupBy(F.col("doc").alias("chat")).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w")).select("chat", capitalised(F.array_join("w.word", ", ")).alias("named"))  # three at most
    return rows.join(names, "chat", "left").select("chat", F.coalesce("title", "named", truncated(F.col("said"), 40)).alias("title"))
