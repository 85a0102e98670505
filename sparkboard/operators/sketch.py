"""Quantiles and distinct counts: exact ones by a global order, sketches that are stored by day and merged.

A quantile sketch counts values in buckets whose edges grow by a constant factor; so a bucket's middle is within
``error`` of every value in it, sketches are merged by adding counts, and their size follows the range of values, not
their number. A distinct sketch is Spark's HLL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import ranked

ERROR, SMALLEST, HLL_BITS = 0.01, 1e-9, 12


def exact_quantiles(df: DataFrame, value: str, at: Sequence[float], within: Sequence[str] = ()) -> DataFrame:
    """``within``, q and value: each quantile of the non-null numbers, between neighbours in proportion, as SQL's quantile_cont has it.

    Numbers are ranked by ranges, so no task holds a group, however large. Groups without a number have no rows.
    """
    groups = [F.col(f"`{c}`") for c in within]
    rows = df.select(*groups, F.col(f"`{value}`").cast("double").alias("value_")).where("value_ is not null")
    placed = ranked(rows, ["value_"], within, name="rank_")
    sizes = rows.groupBy(*[g.alias(f"in{k}_") for k, g in enumerate(groups)]).agg(F.count("*").alias("n_"))
    same = F.lit(True)
    for k, g in enumerate(groups):
        same &= g.eqNullSafe(F.col(f"in{k}_"))
    placed = placed.join(sizes, same) if groups else placed.crossJoin(F.broadcast(sizes))  # one row
    asked = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("place_", (F.col("n_") - 1) * F.col("q") + 1)
    near = asked.where((F.col("rank_") >= F.floor("place_")) & (F.col("rank_") <= F.ceil("place_")))
    low, high = F.min_by("value_", "rank_"), F.max_by("value_", "rank_")
    share = F.first("place_") - F.floor(F.first("place_"))
    return near.groupBy(*groups, "q").agg((low + (high - low) * share).alias("value"))


def bucket(value: Column, error: float = ERROR) -> Column:
    """The signed bucket of a number: 0 up to ``SMALLEST`` in size, else by the logarithm."""
    step = math.log((1 + error) / (1 - error))
    up = (F.ceil(F.ln(F.abs(value) / SMALLEST) / step)).cast("int")
    return F.when(value.isNull(), None).when(F.abs(value) <= SMALLEST, 0).when(value > 0, F.greatest(up, F.lit(1))).otherwise(-F.greatest(up, F.lit(1)))


def middle(of: Column, error: float = ERROR) -> Column:
    """The number that stands for a bucket: within ``error`` of all that fall into it."""
    growth = (1 + error) / (1 - error)
    size = SMALLEST * F.pow(F.lit(growth), F.abs(of)) * 2 / (1 + growth)
    return F.when(of == 0, F.lit(0.0)).otherwise(F.signum(of.cast("double")) * size)


def quantile_sketch(df: DataFrame, value: str, by: Sequence[str], error: float = ERROR) -> DataFrame:
    """``by``, bucket and n: the sketch of the non-null finite numbers of each group; a table to be stored."""
    number = F.col(f"`{value}`").cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")))
    return rows.groupBy(*[f"`{c}`" for c in by], bucket(number, error).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, at: Sequence[float], within: Sequence[str] = (), error: float = ERROR) -> DataFrame:
    """``within``, q and value from sketches, merged over all else: within ``error`` of the number of that rank, in proportion to it.

    Buckets are a few thousand for a group at most, so a window over a group is small.
    """
    groups = [F.col(f"`{c}`") for c in within]
    merged = sketch.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*groups).orderBy("bucket")
    summed = merged.select(*groups, "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(*groups)).alias("all"))
    asked = summed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    hit = asked.where(F.col("upto") >= F.floor((F.col("all") - 1) * F.col("q")) + 1)
    return hit.groupBy(*groups, "q").agg(middle(F.min("bucket"), error).alias("value"))


def distinct_sketch(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``by`` and sketch: an HLL of the non-null values, as text, of each group."""
    return df.groupBy(*[f"`{c}`" for c in by]).agg(F.hll_sketch_agg(F.col(f"`{value}`").cast("string"), HLL_BITS).alias("sketch"))


def distinct_of(sketch: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``within`` and n: about how many values, from sketches merged over all else (standard error 1.6 %)."""
    return sketch.groupBy(*[f"`{c}`" for c in within]).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
