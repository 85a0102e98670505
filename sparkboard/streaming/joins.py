"""Streams joined in bounded time, and late rows kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def joined_in_time(left: DataFrame, right: DataFrame, key: str, at: str, within: str = "1 hour", late: str = "2 hours", kind: str = "inner") -> DataFrame:
    """Pairs of rows with an equal ``key`` of which the right one comes 0 to ``within`` after the left one.

    Right columns get the prefix ``right_``. On streams both sides have a watermark and the condition bounds
    time both ways, so the state of either side is dropped once no partner can come; with ``kind``
    "leftOuter" a left row without partner comes out then. Tables give the same pairs at once. Null keys
    and times find no partner; repeated rows pair each time.
    """
    to = right.select(*[F.col(f"`{c}`").alias(f"right_{c}") for c in right.columns])
    if left.isStreaming:
        left = left.withWatermark(at, late)
    if right.isStreaming:
        to = to.withWatermark(f"right_{at}", late)
    near = F.col(f"right_{at}").between(F.col(f"`{at}`"), F.col(f"`{at}`") + F.expr(f"interval {within}"))
    return left.join(to, (F.col(f"`{key}`") == F.col(f"right_{key}")) & near, kind)


def by_arrival(rows: DataFrame, batch: str, at: str, late: str) -> DataFrame:
    """``rows`` with ``is_late``: whether the row's time is more than ``late`` before the newest time of all earlier batches.

    The batch form of ``LateRows``; running maxima are over one row for each batch. Rows without a time are not late.
    """
    newest = rows.groupBy(F.col(f"`{batch}`").alias("batch_")).agg(F.max(f"`{at}`").alias("newest_"))
    before = Window.orderBy("batch_").rowsBetween(Window.unboundedPreceding, -1)
    marks = newest.select("batch_", F.max("newest_").over(before).alias("mark_"))
    joined = rows.join(marks, F.col(f"`{batch}`").eqNullSafe(F.col("batch_")), "left")
    is_late = F.coalesce(F.col(f"`{at}`") < F.col("mark_") - F.expr(f"interval {late}"), F.lit(False))
    return joined.withColumn("is_late", is_late).drop("batch_", "mark_")


class LateRows:
    """For foreachBatch: rows in time go to one table, late ones to another, each once.

    A row is late if its time is more than ``late`` before the newest one of all earlier
    batches. Every batch writes its rows and its newest time under its number, so a batch that runs
    again overwrites its own and reads the marks of earlier ones alone.
    """

    def __init__(self, spark: SparkSession, path: str, at: str, late: str) -> None:
        self.spark, self.path, self.at, self.late = spark, path.rstrip("/"), at, late

    def write(self) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, number: int) -> None:
            mark = self._mark(number)
            in_time = F.lit(True) if mark is None else ~F.coalesce(F.col(f"`{self.at}`") < F.lit(mark) - F.expr(f"interval {self.late}"), F.lit(False))
            batch = batch.persist()
            try:
                batch.where(in_time).write.mode("overwrite").parquet(f"{self.path}/in_time/batch={number}")
                batch.where(~in_time).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
                batch.agg(F.max(f"`{self.at}`").alias("newest")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")
            finally:
                batch.unpersist()

        return run

    def _mark(self, number: int):
        if number == 0:
            return None
        # one row for each batch so far
        return self.spark.read.parquet(f"{self.path}/marks").where(F.col("batch") < number).agg(F.max("newest")).first()[0]

    def read(self, which: str) -> DataFrame:
        """The rows ``in_time`` or ``late``."""
        return self.spark.read.parquet(f"{self.path}/{which}").drop("batch")
