"""Global order by ranges against windows over all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkboard.operators.order import over_range, placed_among, ranked


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(k, None if k % 50 == 0 else "hot" if k % 3 == 0 else rng.choice("abc"), None if k % 17 == 0 else rng.randint(0, 40), rng.random() * 9) for k in range(900)]
    return spark.createDataFrame(data, "id long, `g.x` string, v int, part double").repartition(7).cache()


def same(got, want):
    names = sorted(want.columns)
    plain = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*[f"`{c}`" for c in names]).collect())
    assert sorted(got.columns) == names and plain(got) == plain(want)


@pytest.mark.parametrize("within", [(), ("g.x",)])
def test_ranks_and_sums(rows, within):
    w = Window.partitionBy(*[f"`{c}`" for c in within])
    w = w.orderBy(F.desc("v"), "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("s", F.coalesce(F.sum("id").over(before), F.lit(0)))
    same(ranked(rows, [("v", "desc"), "id"], within, sums={"s": F.col("id")}), want)
    t = Window.partitionBy(*[f"`{c}`" for c in within]).orderBy("v")
    same(ranked(rows, ["v"], within, ties=True), rows.withColumn("rank", F.rank().over(t).cast("long")))


@pytest.mark.parametrize("within", [(), ("g.x",)])
def test_places(rows, within):
    w = Window.partitionBy(*[f"`{c}`" for c in within]).orderBy("v", "id")
    want = rows.select("*", F.row_number().over(w).cast("long").alias("row_number"), F.rank().over(w).cast("long").alias("rank"), F.ntile(7).over(w).cast("long").alias("ntile"), F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"))
    same(placed_among(rows, ["v", "id"], within, tiles=7), want)


def test_range_frames(rows):
    w = "over (partition by `g.x` order by part range between 1.5D preceding and current row)"
    want = rows.selectExpr("*", f"sum(v) {w} as s", f"count(*) {w} as n", f"first_value(id) {w} as f")
    same(over_range(rows, "part", 1.5, {"s": "sum(v)", "n": "count(*)", "f": "first_value(id)"}, ["g.x"]), want)


def test_no_rows(rows):
    none = rows.limit(0)
    assert ranked(none, ["v"]).count() == placed_among(none, ["v"]).count() == over_range(none, "v", 2, {"n": "count(*)"}).count() == 0
