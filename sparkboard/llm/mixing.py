"""Mixing sources to target weights with a low-discrepancy schedule.

Slots are points of the golden-ratio sequence, mapped through the cumulative
targets to a source; a slot's rank among its source's slots says which block of
tokens it takes. A source's blocks are equal stretches of its documents in shuffled
order, taken round and round. Only DataFrame functions are used. Running sums and
ranks are taken in two levels, over buckets first, so that no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BUCKETS, CHUNK, CELLS = 1024, 1 << 9, 1 << 10
SLOTS_PER_SOURCE, LARGEST_BLOCK = 1000, 1 << 16
GOLDEN = 0.6180339887498949
MOST = 3  # times that a document may be taken


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_size, weight and target for (source, source_size), one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3 and again; they share the
    sum of all sizes; no target is above ``MOST`` times its source's size.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(MOST))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source, by cap over weight, that the level of those left does not fill sets the level
    levelled = ranked.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"]
    return levelled.withColumn("target", F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def _shuffled(sized: DataFrame) -> DataFrame:
    """``at``: the words of the source before each document, in an order drawn by hash."""
    drawn = sized.withColumn("draw", F.xxhash64("doc_id", "size")).withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)))
    buckets = drawn.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source_key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["source_key", "bucket"]).withColumn("at", F.col("start") + F.col("own")).drop("draw", "own", "start")


def _schedule(targets: DataFrame, slots: int, block: int) -> DataFrame:
    """(slot, source_key, rank): the source of each golden-ratio point, and the slot's rank in it."""
    spark = targets.sparkSession
    total = Window.partitionBy()
    before = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    shares = targets.where("target > 0").select("source_key", "need", (F.coalesce(F.sum("target").over(before), F.lit(0.0)) / F.sum("target").over(total)).alias("low"), (F.sum("target").over(Window.orderBy("source_key")) / F.sum("target").over(total)).alias("high"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    ranges = shares.select("source_key", "low", F.when(F.col("high") > 1 - 1e-12, 2.0).otherwise(F.col("high")).alias("high"), F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id + 1) * {GOLDEN}D - floor((id + 1) * {GOLDEN}D)").alias("point"))
    drawn = points.withColumn("cell", cell(F.col("point"))).join(ranges, "cell").where("point >= low and point < high").select("slot", "source_key", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("source_key", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_key", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    ranked = drawn.withColumn("own", F.row_number().over(Window.partitionBy("source_key", "chunk").orderBy("slot")) - 1).join(starts, ["source_key", "chunk"]).select("slot", "source_key", (F.col("start") + F.col("own")).alias("rank"))
    # low discrepancy leaves a source a few slots short at most: those follow at the end
    had = counts.groupBy("source_key").agg(F.sum("n").alias("had"))
    late = shares.join(had, "source_key", "left").withColumn("had", F.coalesce("had", F.lit(0).cast("long"))).where("had < need").select("source_key", F.explode(F.expr("sequence(had, need - 1)")).alias("rank"))
    return ranked.unionByName(late.select(F.lit(slots).cast("long").alias("slot"), "source_key", "rank"))


def mixed(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``documents``.

    ``taken`` are the words that the mix takes of the document, repeats counted:
    ``MOST`` times its size at most; over a source they sum to its target, rounded
    to a word. A null text has size 0 and is not taken; a null source is a source
    of its own, last in order. Rows alike in doc_id, source and size are exchanged
    freely, so reruns agree. A text of any length counts whole; other columns play no
    part, but the table of sources must fit one task. An empty table gives an empty table.
    """
    sized = written(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = written(targets.withColumn("source_key", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "targets")
    total, n_sources = targets.agg(F.sum("source_size"), F.count("*")).first()
    total, n_sources = int(total or 0), int(n_sources)
    block = max(1, min(LARGEST_BLOCK, total // (max(1, n_sources) * SLOTS_PER_SOURCE)))
    slots = -(-total // block)
    words = F.round("target").cast("long")
    rounds = F.floor(words / F.greatest("source_size", F.lit(1))).cast("long")
    rest = words - rounds * F.col("source_size")
    per_round = F.ceil(F.col("source_size") / block).cast("long")
    targets = targets.withColumn("per_round", per_round).withColumn("words", words).withColumn("need", F.when(F.col("source_size") > 0, rounds * per_round + F.ceil(rest / block).cast("long")).otherwise(F.lit(0).cast("long")))
    schedule = _schedule(targets, slots, block).join(targets.select("source_key", "need", "per_round", "source_size", "words"), "source_key").where("rank < need")
    # a slot takes a whole block, but for the last one, which ends with the target
    number, turn = F.col("rank") % F.col("per_round"), F.floor(F.col("rank") / F.col("per_round")).cast("long")
    stop = F.least((number + 1) * block, F.col("source_size"), F.greatest(F.col("words") - turn * F.col("source_size"), F.lit(0)))
    uses = schedule.select("source_key", number.alias("block"), stop.alias("stop")).groupBy("source_key", "block", "stop").agg(F.count("*").alias("times"))
    placed = _shuffled(sized.join(targets.select(F.col("source").alias("s"), "source_key", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    numbers = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / block).cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))
    pieces = placed.withColumn("block", F.explode(numbers))
    part = F.greatest(F.least(F.col("at") + F.col("size"), F.col("stop")) - F.greatest(F.col("at"), F.col("block") * block), F.lit(0)) * F.col("times")
    row = ["doc_id", "source", "size", "source_size", "target", "source_key", "at"]
    joined = pieces.join(uses, ["source_key", "block"], "left")
    tagged = joined.groupBy(*row).agg(F.sum(F.coalesce(part, F.lit(0))).cast("long").alias("taken"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("blanks"))
    # rows of size 0 share a place: each comes back as often as it was there
    return tagged.select("doc_id", "source", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.greatest(F.col("blanks").cast("int"), F.lit(1))))).drop("col")


def mix(documents: DataFrame) -> DataFrame:
    """``documents`` as mixed, with their own columns, whatever their names: a row each time
    a document is taken; where the last block of a source cuts a document, only the words
    taken stay. Null, empty and blank texts have no words and are not taken. Rows alike in
    id, source and size share what is planned for them out among themselves, to the word.
    An empty table gives an empty table.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    key = F.concat_ws("\0", "size", known("doc_id"), known("source")).alias("key")
    # rows alike in id, source and size have one list of plans, of which each takes its own
    plan = mixed(documents).where("size > 0").select(key, "taken").groupBy(F.col("key").alias("key_")).agg(F.array_sort(F.collect_list("taken")).alias("plans"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, "doc_id", "source", n_words(F.col("text")).alias("size")).where("size > 0").select("row", "size", key)
    number = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    joined = rows.join(plan, F.col("key") == F.col("key_")).withColumn("taken", F.element_at("plans", number)).where("taken > 0")
    turns = joined.select("row", "size", F.explode(F.expr("transform(sequence(0L, (taken - 1) div size), i -> least(size, taken - i * size))")).alias("left"))
    first_words = F.array_join(F.slice(F.expr(r"regexp_extract_all(row.text, '[^\\x20\\x09-\\x0D]+', 0)"), F.lit(1), F.col("left").cast("int")), " ")
    text = F.when(F.col("left") == F.col("size"), F.col("row.text")).otherwise(first_words)
    return turns.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns])
