"""Streaming forms: event-time windows with watermarks, counters, upserts, refreshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files under ``path``, with the schema they have now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of each tumbling window; batch and stream alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "6 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n of each session: events of a user with no gap that long."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counters(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Counts for each key, for update mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def upsert_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the latest row of each key in a Parquet table of versions.

    Each batch writes path/upsert_batch=<batch>, so a batch that runs again writes the same
    version anew; readers take ``latest``.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/upsert_batch={number}")

    return write


def latest(spark: SparkSession, path: str, key: str, order: str, deleted: str | None = None) -> DataFrame:
    """The present state of an upserted table, without keys whose latest row has ``deleted`` set."""
    versions = spark.read.parquet(path)
    newest = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), F.struct(order, "upsert_batch")).alias("r"))
    rows = newest.select("r.*").drop("upsert_batch")
    return rows if deleted is None else rows.where(~F.coalesce(deleted, F.lit(False))).drop(deleted)


def deletions(keys: DataFrame, key: str, order: str, at: Column, schema: StructType, deleted: str = "deleted") -> DataFrame:
    """Rows for ``upsert_into`` that delete keys: key, order and ``deleted`` are set, all else is null.

    ``schema`` is that of the table with its ``deleted`` column. All keys of the table
    given, the table is cleared.
    """
    given = {key: F.col(key), order: at, deleted: F.lit(True)}
    return keys.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def overwrite_dataset(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a source refresh that replaces a dataset as a whole.

    Each batch is a version of its own, so a run that breaks off between two steps
    leaves the version before it; ``newest_dataset`` reads the last one that is complete.
    """
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/v={number}")


def newest_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version of a dataset that ``overwrite_dataset`` keeps."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [x.getPath().getName() for x in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/{max(done, key=lambda name: int(name.partition('=')[2]))}")


def learn(state: DataFrame, phrases: DataFrame, least: float = 0.85, most: int = 300) -> DataFrame:
    """Learned phrases after a batch: a phrase whose words are nearly those of a known one
    replaces it, others are added, and the ``most`` latest stay. Columns: phrase, intent, at."""
    from ..functions.text import jaccard, words

    old = state.select("phrase", "intent", "at", F.array_distinct(words(F.col("phrase"))).alias("a"))
    new = phrases.select(F.array_distinct(words(F.col("phrase"))).alias("b"))
    same = old.withColumn("w", F.explode("a")).join(new.withColumn("w", F.explode("b")), "w").where(jaccard(F.col("a"), F.col("b")) > least).select("phrase").distinct()
    kept = state.join(same, "phrase", "left_anti")
    return kept.select("phrase", "intent", "at").unionByName(phrases.select("phrase", "intent", "at")).orderBy(F.desc("at"), F.asc("phrase")).limit(most)
