"""What the operators of this subpackage share: tables in the shared folder, components, sizes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import BATCH_BYTES, BATCH_ROWS, give_back, released, small_batches
from ..scratch import drop_written, shared_folder, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "components", "drop_written", "free_name", "give_back", "input_bytes", "released", "shared_folder", "small_batches", "small_table", "written"]


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver knows. It goes by Arrow to the JVM: rows
    from a list would be pickled by Python workers, which then stay in the executors."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    names, types = zip(*(f.split() for f in schema.split(",")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds[t]) for n, t, c in zip(names, types, columns, strict=True)}), schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; it costs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for the undirected ``edges`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps, whose number grows with the
    logarithm of the component sizes; each step moves a row per edge, never a
    neighbour list, and is written to the shared folder. Nulls and loops are
    dropped; an empty table gives an empty table.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    count = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = count(now)
    for _ in range(limit):
        if not was[0]:
            break
        both = now.union(now.select("b", "a").toDF("a", "b"))
        # dealt by both in between: the join then meets two shuffled sides, of which a node with very many neighbours can be split
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition("m", "a")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.join(least, "a").where("a <> m").select("a", "m")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = written(small, "edges")
        then = count(now)
        if then == was:
            break
        was = then
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
