"""The keyed store under compaction, fetchers, ordered CSV, language order, functions by name."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkboard.functions import catalog
from sparkboard.operators import locale, retrieval
from sparkboard.sources import fetch, sinks
from sparkboard.streaming.kv import KeyValue

SCHEMA = "k long, at long, v string, deleted boolean"


def test_compaction_changes_no_state(spark, tmp_path):
    rng, want = random.Random(2), {}
    store = KeyValue(spark, str(tmp_path / "kv"), SCHEMA, "k", "at", base=4, ratio=2)
    have = lambda: {r.k: r.v for r in store.state().collect()}
    assert have() == {}
    store.compact()
    for n in range(9):
        rows = [(rng.randrange(20), 100 * n + i, f"v{n}.{i}", rng.random() < 0.3) for i in range(6)] + [(50, 0 if n else 5, f"old {n}", False)]  # key 50: what comes later is older
        store.write()(spark.createDataFrame(rows, SCHEMA), n)
        store.write()(spark.createDataFrame(rows, SCHEMA), n)  # the batch runs again
        for k, at, v, gone in sorted(rows, key=lambda r: r[1]):
            if k != 50 or n == 0:
                want.pop(k, None)
                if not gone:
                    want[k] = v
        assert have() == want
        if n % 2:
            (tmp_path / "kv" / "manifest" / str(90 + n)).mkdir(parents=True)  # a compaction that broke off before its manifest was whole
            store.compact()
            assert have() == want
            store.write()(spark.createDataFrame([(1, 10_000, "again", False)], SCHEMA), n)  # a merged batch that runs again does nothing
            assert have() == want
            assert len(store.runs()) <= 4
    levels = [m[0] for m in store._manifest()]
    assert max(levels) > 1 and len(levels) == len(set(levels))
    files = {p.parent.name for p in (tmp_path / "kv" / "runs").rglob("*.parquet")}
    assert len(files) <= 2 * len(levels) + 2  # old runs are deleted


def test_chain_of_fetchers_and_cache(spark, tmp_path):
    files = tmp_path / "web"
    files.mkdir()
    for name in ("a", "b"):
        (files / name).write_text(f"page {name} " * 9)
    folder, log = str(files), str(tmp_path / "log")

    def from_files(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        with open(f"{folder}/{url.rsplit('/', 1)[1]}") as f:
            return f.read(), "text/plain"

    def refuses(url):
        raise ValueError("HTTP 403") if "b" in url.rsplit("/", 1)[1] else TimeoutError()

    urls = spark.createDataFrame([("http://X.example/a",), ("http://x.example/b",), ("http://y.example/c",), ("http://y.example/c",), (None,)], "url string")
    stored = spark.createDataFrame([("http://y.example/c", "short"), ("http://x.example/b", "a stored text of some length")], "u string, t string")
    chain = [("app", fetch.from_function(refuses)), ("table", fetch.from_table(stored, "u", "t")), ("files", fetch.from_function(from_files, lanes=1))]
    got = {r.url[-1]: r for r in fetch.fetched(urls, chain).collect()}
    assert {k: r.via for k, r in got.items()} == {"a": "files", "b": "table", "c": None}
    assert got["b"].errors == ["app: HTTP 403"] and got["a"].errors == ["app: TimeoutError", "table: not stored"] and got["a"].content_type == "text/plain"
    assert [e.split(":")[0] for e in got["c"].errors] == ["app", "table", "files"] and got["c"].errors[1] == "table: empty answer"
    assert [r.h for r in urls.where("url like '%a'").select(fetch.host(F.col("url")).alias("h")).collect()] == ["x.example"]
    open(log, "w").close()
    cache, at = str(tmp_path / "cache"), lambda m: F.lit(datetime.datetime(2024, 1, 1, 0, m))
    ask = lambda m: {r.url[-1]: r.via for r in fetch.with_cache(spark, cache, urls, chain, at(m)).collect()}
    assert ask(0) == ask(5) == {"a": "files", "b": "table", "c": None}
    assert open(log).read().count("/a") == 1  # read once, then from the cache
    assert ask(30) == {"a": "files", "b": "table", "c": None} and open(log).read().count("/a") == 2


def test_ordered_csv(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, rng.choice(["plain", 'a "quoted" one', "semi;colon", "two\r\nlines", "é ç", None]), k * 0.5) for k in rng.sample(range(300), 300)]
    df = spark.createDataFrame(rows, "id long, `a;b` string, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_ordered_csv(df, str(tmp_path / "out"), ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out").glob("part-*"))
    whole = b"".join(p.read_bytes() for p in parts)
    assert len(parts) > 1 and whole.startswith(b'\xef\xbb\xbfid;"a;b";x\r\n0;') and whole.count(b"\xef\xbb\xbf") == 1
    import csv
    import io

    got = list(csv.reader(io.StringIO(whole.decode("utf-8-sig"), newline=""), delimiter=";"))
    assert got[1:] == [[str(k), v or "", str(x)] for k, v, x in sorted(rows)]
    back = sinks.read_ordered_csv(spark, str(tmp_path / "out"), "id long, `a;b` string, x double")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((k, v and v.replace("\r\n", "\n"), x) for k, v, x in rows), key=str)
    sinks.write_ordered_csv(df.limit(0), str(tmp_path / "none"), ["id"])
    assert sinks.read_ordered_csv(spark, str(tmp_path / "none"), "id long, `a;b` string, x double").count() == 0


def test_language_order(spark):
    words = ["água", "agua", "Água", "abelha", "cor", "çor", "coração", "Zebra", "zebra", "ênfase", "enfim", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in locale.sorted_by(df, "w", ties=["w"]).collect()]
    assert got == ["abelha", "agua", "água", "Água", "cor", "çor", "coração", "ênfase", "enfim", "zebra", "Zebra", None]
    assert {(r.w, r.n) for r in locale.groups(df, "w", {"n": F.count("*")}).collect()} >= {("agua", 3), ("Zebra", 2), (None, 1), ("cor", 2)}
    assert locale.groups(df, "w", {"n": F.count("*")}, accents=True).where("n = 2").count() == 2  # água, Água; Zebra, zebra
    right = spark.createDataFrame([("AGUA", 1), ("zebra", 2), (None, 3)], "r string, x int")
    assert sorted(r.w for r in locale.joined(df, right, "w", "r").collect()) == ["Zebra", "agua", "zebra", "Água", "água"]


def test_functions_by_name(spark):
    catalog.register(spark)
    docs = spark.createDataFrame([(1, "One sentence here. " * 90), (2, None), (3, "")], "doc_id long, text string")
    by_name = spark.sql("SELECT d.doc_id, c.start, c.chunk FROM {docs} d, LATERAL chunk_text(d.text, 300) c", docs=docs)
    columns = retrieval.chunked(docs, "doc_id", "text", 300)
    assert sorted(map(tuple, by_name.collect())) == sorted((r[0], r.start, r.chunk) for r in columns.collect()) and by_name.count() > 3
    with pytest.raises(Exception, match="positive constant"):
        spark.sql("SELECT * FROM {docs} d, LATERAL chunk_text(d.text, 0) c", docs=docs).collect()
