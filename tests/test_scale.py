"""Steps that must grow with the input alone: the same results as plain forms, without their work."""

import random

from pyspark.sql import functions as F

from sparkboard.functions import text
from sparkboard.operators import retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_word_has_one_stem_in_both_forms(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice(["ca", "s", "oes", "ar", "1", "mente", "-", "les", "x", "eis", "nr", "a"]) for _ in range(rng.randint(1, 5))) for _ in range(2000)]
    rows = spark.createDataFrame([(w,) for w in [*made, *text.STOPWORDS, "nr-12", "nr12", "nr-1x"]], "w string")
    got = rows.select("w", text.stem(F.col("w")).alias("s"), F.transform(text.content_words(F.col("w")), text.stem).alias("t"), text.words(F.col("w")).alias("all")).collect()
    assert all(text.stem_of(r.w) == r.s for r in got)
    nr = lambda w: text.token_of(w)
    assert all([t for w in r["all"] if (t := nr(w)) is not None] == r.t for r in got if not any(w.startswith("nr") for w in r["all"]))
    assert [nr(w) for w in ("nr-12", "nr12", "a", "de")] == ["nr12", "nr12", None, None]


def test_stemmed_bm25_shuffles_no_text(spark):
    rng = random.Random(8)
    bits = "extintor extintores galpao galpoes trabalho altura cinto cintos empilhadeira de a nr-12 prazo".split()
    docs = spark.createDataFrame([(k, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for k in range(120)] + [(500, None)], "id int, t string")
    asked = spark.createDataFrame([(1, "extintores no galpão"), (2, "empilhadera e cintos"), (3, "zzz"), (4, None)], "q int, t string")
    rows = lambda df: sorted((r["query"], r.doc, round(r.score, 9), round(r.coverage, 9)) for r in df.collect())
    want = retrieval.bm25(retrieval.build_index(docs, "id", "t"), asked, "q", "t", k=None)
    assert rows(retrieval.bm25_best(docs, "id", "t", asked, "q", "t", None, fuzzy=True, stems=True)) == rows(want)
    best = retrieval.bm25_best(docs, "id", "t", asked, "q", "t", 3, fuzzy=True, stems=True)
    assert {r["query"]: r.n for r in best.groupBy("query").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 3}
    assert "MapInArrow" in plan(best) and "explode" not in plan(best)


def test_dislikes_read_an_answer_once(spark):
    from sparkboard.operators import memory

    rng = random.Random(2)
    said = [(rng.choice("ab"), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for _ in range(150)]
    answers = spark.createDataFrame(said, "intent string, text string")
    bad = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(said[:40])], "intent string, text string, at int")
    like = lambda x, y: bool(x | y) and len(x & y) / len(x | y) > 0.6
    want = sorted((i, t) for i, t in said if any(i == j and like(set(t.split()), set(u.split())) for j, u in said[10:40]))
    got = memory.disliked(answers, bad, most=30, least=0.6)
    assert sorted((r.intent, r.text) for r in got.collect()) == want
    assert got.columns == ["intent", "text"]
    assert "regexp_extract_all" not in plan(got).split("BroadcastHashJoin", 1)[1].split("\n")[0]


def test_csv_keeps_line_ends_out_of_cells(spark, tmp_path):
    from sparkboard.sources import sinks

    said = ["a\nb", "plain", "c\r\nd", "e\rf", 'q "x";', " s ", "\\", "á", "end\n"] * 5
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k long, t string")
    sinks.write_ordered_csv(rows.repartition(7), str(tmp_path / "x"), ["k"])
    assert {r.k: r.t for r in sinks.read_ordered_csv(spark, str(tmp_path / "x"), "k long, t string").collect()} == dict(enumerate(said))


def test_groups_of_the_language_are_those_of_the_sql(spark):
    import duckdb

    from sparkboard import queries_live  # noqa: F401
    from sparkboard.operators import locale
    from sparkboard.queries import ORACLE_SQL

    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]
    words = [*letters, "ss", "ae", "th", "Straße", "strasse", "STRASSE", "Ærø", "aero", "dða"]
    got = locale.groups(spark.createDataFrame([(w,) for w in words], "word string"), "word", {"n": F.count("*")})
    with duckdb.connect() as con:
        con.execute("CREATE TABLE conversations (text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?)", [(w,) for w in words])
        assert sorted(con.execute(ORACLE_SQL["locale_groups"]).fetchall()) == sorted(tuple(r) for r in got.collect())


def folds(spark, c):
    docs = spark.createDataFrame([("remova o gráfico de acidentes",)], "t string")
    return plan(docs.select(c.alias("x"))).split("Project", 1)[1].split("\n")[0].count("translate(")


def test_similar_names_are_folded_once(spark):
    assert folds(spark, text.dice(F.col("t"), F.lit("x"))) <= 2 * folds(spark, text.norm(F.col("t")))


def test_types_of_documents_count_words_of_one_split(spark):
    from sparkboard.operators import classify

    kinds = (classify.DocType("x", ("the", "n/a", "o_k", "a b")),)
    docs = spark.createDataFrame([(1, "The the, the_ n/a n/a o_k a b a bc"), (2, None), (3, "the " * 9)], "id int, t string")
    got = classify.doc_type_scores(docs, "id", "t", kinds)
    assert {r.doc: r.score for r in got.collect()} == {1: 6, 2: 0, 3: 4}
    assert "split(" in plan(got)


def test_rules_read_the_normal_form_once(spark):
    from sparkboard.operators import classify
    from sparkboard.plans import edit

    assert folds(spark, classify.intent(F.col("t"))) == folds(spark, edit.edit(F.col("t"))) == folds(spark, text.norm(F.col("t")))


def test_widgets_read_the_normal_form_once(spark):
    from sparkboard.plans import request

    asked = request.widget(F.col("t"), F.lit("2026-09-28").cast("date"))
    assert folds(spark, asked) <= 2 * folds(spark, text.norm(F.col("t")))  # months in its data are folded too


def test_activities_shuffle_no_text(spark):
    from sparkboard.operators import knowledge

    base = spark.createDataFrame([("altura", "trabalho em altura", ["andaime"])], "activity string, name string, terms array<string>")
    said = spark.createDataFrame([(1, "o andaime"), (2, "andaimi"), (3, "trabalho em altura"), (4, None)], "id int, t string")
    got = knowledge.find_activities(said, "id", "t", base)
    assert sorted((r.doc, r.score) for r in got.collect()) == [(1, 7), (2, 6), (3, 40)]
    assert plan(got).count("BroadcastHashJoin") >= 2


def test_keywords_shuffle_no_text(spark):
    docs = spark.createDataFrame([(1, "extintores extintor trabalho no galpao"), (1, "trabalho"), (2, None), (None, "cintos cinto cinto"), (None, "empilhadeiras")], "id int, t string")
    found = retrieval.keywords(docs, "id", "t", 2)
    assert sorted(tuple(r) for r in found.where("doc is not null").collect()) == [(1, 1, "extintor", "extintor", 2), (1, 2, "trabalh", "trabalho", 2)]
    assert sorted((r["rank"], r.word, r["count"]) for r in found.where("doc is null").collect()) == [(1, "cinto", 3), (2, "empilhadeiras", 1)]
    assert "Exchange" not in plan(retrieval.keywords(docs.where("t like 'ext%'"), "id", "t", 2))


def test_texts_go_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    retrieval.chunked(spark.createDataFrame([(1, "a")], "id int, t string"), "id", "t")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_pages_go_to_python_in_small_batches(spark):
    from sparkboard.sources import web

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    web.main_content(spark.createDataFrame([(1, "<p>a</p>")], "id int, t string"), "id", "t")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_stems_of_requests_are_made_in_the_task(spark):
    rows = spark.createDataFrame([(1, "Extintores, extintor e nr-12"), (1, "extintor"), (2, None), (3, "de a")], "id int, t string")
    got = retrieval.term_counts(rows, "id", "t")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "extintor", 3), (1, "nr12", 1)]
    assert "MapInArrow" in plan(got)


def test_questions_of_one_text_are_answered_once(spark):
    from sparkboard.operators import guide

    known = guide.entries(norms=spark.createDataFrame([(35, "Trabalho em altura", "cinto e linha de vida", "altura")], "number int, title string, summary string, keywords string"))
    asked = spark.createDataFrame([(k, "trabalho em altura com cinto") for k in range(50)] + [(60, "trabalho em"), (60, "altura com cinto"), (None, "altura"), (70, None)], "q int, t string")
    found = guide.found(asked, "q", "t", known, 1)
    got = {r.question: (r.id, round(r.score, 9), r.coverage) for r in found.collect()}
    assert set(got) == {*range(50), 60} and len(set(got.values())) == 1
    assert "same" in plan(found)
