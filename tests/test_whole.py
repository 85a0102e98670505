"""Queries do the whole job: no subset of items, no prefix of a text, no cap on what is returned."""

import collections
import math

from pyspark.sql import functions as F

from sparkboard.functions import entities
from sparkboard.operators import retrieval
from sparkboard.queries import QUERIES


def test_bm25_top_ranks_every_item(spark, tmp_path):
    texts = {d: " ".join(f"w{(d * k) % 23}" for k in range(1, 4 + d % 5)) for d in range(30)}
    items = {i: f"w{i % 23} w{(i * 5 + 1) % 23}" for i in range(25)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bags = {d: collections.Counter(t.split()) for d, t in texts.items()}
    df = collections.Counter(w for bag in bags.values() for w in bag)
    mean = sum(sum(bag.values()) for bag in bags.values()) / len(bags)
    want = set()
    for i, t in items.items():
        known = {w for w in t.split() if w in df}
        found = []
        for d, bag in bags.items():
            hit = known & bag.keys()
            score = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.4 / (bag[w] + 1.4 * (0.28 + 0.72 * sum(bag.values()) / mean)) for w in hit)
            if score > 0.01:
                found.append((-round(score, 9), d, round(score, 6), round(len(hit) / len(known), 6)))
        want |= {(i, d, score, share) for _, d, score, share in sorted(found)[:5]}
    assert max(i for i, *_ in want) == 24
    assert {tuple(r) for r in QUERIES["bm25_top"](spark, str(tmp_path)).collect()} == want


def test_text_quality_judges_whole_texts(spark, tmp_path):
    texts = {1: "a" * 6000 + "#" * 6000, 2: "#" * 3000 + "a" * 9000, 3: "", 4: None, 5: "a#"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.q for r in QUERIES["text_quality"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: 0.0, 4: 0.0, 5: 0.5}


def test_entities_all_has_no_cap(spark, tmp_path):
    mails = [f"m{k}@example.org" for k in range(40)]
    phones = [f"(11) 9{1000 + k}-{2000 + k}" for k in range(30)]
    short = [f"{3000 + k}-{4000 + k}" for k in range(20)]
    text = " ; ".join([*short, *phones, *mails])
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["entities_all"](spark, str(tmp_path)).collect()}
    assert got[1].emails == mails and len(got[1].phones) == 30 and got[2].emails == [] == got[2].phones
    capped = spark.range(1).select(entities.entities(F.lit(text), "phones", 12).alias("v")).first().v
    assert capped == got[1].phones[:12]


def test_report_inventory_covers_every_activity(spark, tmp_path):
    rows = [(k, f"part {k}", f"Brand#{k % 37}", "SMALL", k % 50) for k in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["report_inventory"](spark, str(tmp_path)).collect()
    assert sorted((r.activity, r.hazard) for r in got) == sorted((b, f"{n} {k}") for k, n, b, _, _ in rows)


def test_table_sort_returns_every_row_in_order(spark, tmp_path):
    rows = [(k, ("B", "a", "c", "A")[k % 4] + f"{k * 7 % 31:02}") for k in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in QUERIES["table_sort"](spark, str(tmp_path)).collect()]
    assert got == sorted(rows, key=lambda r: (r[1].lower(), r[1], r[0]))


def test_bm25_best_scores_documents_where_they_lie(spark, monkeypatch):
    texts = [(d, None if d % 17 == 0 else "" if d % 19 == 0 else " ".join(f"w{(d * k) % 29}" for k in range(1, 3 + d % 7))) for d in range(200)]
    items = [(i, f"w{i % 31} w{(i * 3) % 29} Zz{i}") for i in range(20)] + [(3, "w7"), (90, None), (None, "w1"), (91, "never")]
    docs = spark.createDataFrame(texts, "id long, t string").repartition(3)
    asked = spark.createDataFrame(items, "q long, t string")
    rows = lambda: [(r["query"], r.doc, round(r.score, 9), round(r.coverage, 9), r["rank"]) for r in retrieval.bm25_best(docs, "id", "t", asked, "q", "t", k=4).collect()]
    scanned = rows()
    monkeypatch.setattr(retrieval, "HITS", 50)  # blocks of a document or two
    assert sorted(rows()) == sorted(scanned)
    monkeypatch.setattr(retrieval, "MOST_BROADCAST", 10)  # the query set counts as large and is joined to an index
    assert sorted(rows()) == sorted(scanned)
    assert max(r[4] for r in scanned) == 4 and {r[0] for r in scanned} == set(range(20))
    empty = docs.where("id < 0")
    assert retrieval.bm25_best(empty, "id", "t", asked, "q", "t").count() == 0
    assert retrieval.bm25_best(docs, "id", "t", asked.where("q < 0"), "q", "t").count() == 0
