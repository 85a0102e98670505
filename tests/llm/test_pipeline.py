"""The pipeline on a small table: each stage's decisions take effect."""

import collections
import random

import corpus_pipeline
from sparkboard.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert [q for q in QUERIES if q.startswith("op")] and len({q.split("_")[0] for q in QUERIES}) == 13
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    parts = {"aa": "the and ing tion of re".split(), "bb": "der und ung sch zu en".split()}
    make = lambda la, n=60: " ".join("".join(rng.choices(parts[la], k=3)) for _ in range(n))
    leak = make("aa", 12)
    rows = [(k, make(la), la, f"s{k % 3}", 0) for k in range(90) for la in [("aa", "bb")[k % 2]]]
    rows += [(100, "123 456", "aa", "s0", 0), (101, rows[4][1], "aa", "s1", 0), (102, f"{make('aa', 30)} {leak.upper()} {make('aa', 30)}", "aa", "s1", 0), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}
    assert ids["language_id"] == set(range(90)) | {101, 102}
    assert ids["near_duplicates"] == set(range(90)) | {102}
    assert leak.upper() not in next(r.text for r in seen["decontamination"] if r.doc_id == 102)
    assert ids["mixing"] <= ids["decontamination"] and max(collections.Counter(r.doc_id for r in seen["mixing"]).values()) <= 3
    assert collections.Counter(r.doc_id for r in seen["sharding"]) == collections.Counter(r.doc_id for r in seen["mixing"])
