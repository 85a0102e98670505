"""Pages by their addresses: a chain of fetchers, each for what those before it could not read.

A fetcher is a function of a table of addresses; ``from_table`` joins stored pages, ``from_function`` calls a function for each
address in tasks that hold hosts, a bounded number of lanes for each. What no fetcher could read keeps the errors of all.
A cache table holds what was read, with its time; rows older than ``expiry`` are read anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Fetcher = Callable[[DataFrame], DataFrame]
SHORTEST = 20  # fixed value: a shorter text counts as none
_READ = "url string, text string, content_type string, error string"


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def from_table(pages: DataFrame, url: str, text: str, content_type: Column | None = None) -> Fetcher:
    """Reads stored pages: of one address given twice the text that is the larger in order."""
    stored = pages.groupBy(F.col(f"`{url}`").alias("url_")).agg(F.max(F.struct(F.col(f"`{text}`").cast("string").alias("text"), (content_type if content_type is not None else F.lit("")).alias("content_type"))).alias("page"))

    def run(urls: DataFrame) -> DataFrame:
        found = urls.join(stored, F.col("url") == F.col("url_"), "left")
        return found.select("url", "page.text", "page.content_type", F.when(F.col("page").isNull(), "not stored").alias("error"))

    return run


def from_function(read: Callable[[str], str | tuple[str, str]], lanes: int = 2) -> Fetcher:
    """Calls ``read`` for each address: it returns a text, or a text and its content type, or raises. An address of a
    host goes to one of ``lanes`` tasks, so no host is asked by more at once; timeouts are ``read``'s own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    got = read(url)
                    text, kind = (got, "") if isinstance(got, str) else got
                    rows.append((url, text, kind, None))
                except Exception as e:  # noqa: BLE001 - whatever a fetcher raises is one entry in the list of errors
                    rows.append((url, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["url", "text", "content_type", "error"])

    return lambda urls: urls.repartition(host(F.col("url")), F.pmod(F.xxhash64("url"), F.lit(lanes))).mapInPandas(run, _READ)


def fetched(urls: DataFrame, chain: Sequence[tuple[str, Fetcher]], url: str = "url") -> DataFrame:
    """url, text, content_type, via and errors for each distinct address; via names the fetcher that read it, null if none did.

    An empty text, or one of under 20 characters, is an error too. Null addresses are left out; no addresses give no rows.
    """
    left = urls.select(F.col(f"`{url}`").alias("url")).where("url is not null").distinct()
    left = left.withColumn("errors", F.array().cast("array<string>"))
    out = None
    for name, fetcher in chain:
        tried = fetcher(left.select("url")).withColumnRenamed("url", "url_")
        short = F.coalesce(F.length("text"), F.lit(0)) < SHORTEST
        error = F.coalesce("error", F.when(short, F.lit("empty answer")))
        tried = tried.withColumn("error", error)
        joined = left.join(tried, F.col("url") == F.col("url_")).drop("url_")
        read = joined.where("error is null").select("url", "text", "content_type", F.lit(name).alias("via"), "errors")
        out = read if out is None else out.unionByName(read)
        left = joined.where("error is not null").select("url", F.concat("errors", F.array(F.concat(F.lit(f"{name}: "), "error"))).alias("errors"))
    none = F.lit(None).cast("string")
    lost = left.select("url", none.alias("text"), none.alias("content_type"), none.alias("via"), "errors")
    return lost if out is None else out.unionByName(lost)


def with_cache(spark: SparkSession, path: str, urls: DataFrame, chain: Sequence[tuple[str, Fetcher]], at: Column, expiry: str = "10 minutes", url: str = "url") -> DataFrame:
    """``fetched``, but addresses read less than ``expiry`` before ``at`` come from the cache table under ``path``, to which what is read now is added."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "url string, text string, content_type string, via string, errors array<string>, fetched_at timestamp"
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    cache = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    fresh = cache.where(F.col("fetched_at") > at.cast("timestamp") - F.expr(f"interval {expiry}"))
    newest = fresh.groupBy("url").agg(F.max_by(F.struct("text", "content_type", "via", "errors", "fetched_at"), "fetched_at").alias("r")).select("url", "r.*")
    asked = urls.select(F.col(f"`{url}`").alias("url")).where("url is not null").distinct()
    read = fetched(asked.join(newest.select("url"), "url", "left_anti"), chain).where("via is not null").withColumn("fetched_at", at.cast("timestamp"))
    read.write.mode("append").parquet(path)
    now = spark.read.schema(schema).parquet(path).where(F.col("fetched_at") > at.cast("timestamp") - F.expr(f"interval {expiry}"))
    latest = now.groupBy("url").agg(F.max_by(F.struct("text", "content_type", "via", "errors", "fetched_at"), "fetched_at").alias("r"))
    return asked.join(latest, "url", "left").select("url", "r.*")
