"""Resharding by minimum-cost flow: the fewest bytes move to shards of near equal size.

Old shards are sources of a flow network, new shards its sinks with near equal
capacities; a byte that stays costs nothing, a byte that moves costs one. The flow
is solved on the driver over the shards alone (a few numbers for each pair). Each
old shard is then cut by running sums of bytes over its documents in hash order,
in size classes: each class evens out what the larger documents left uneven.
Running sums are taken over blocks first, so no task holds a shard.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_name, small_table, written

OVERHEAD = 16
BLOCKS = 256  # of documents, in each old shard and size class
CLASSES = (8, 64, 512)  # a class ends at this part of a new shard's capacity


def min_cost_flow(supply: list[int], capacity: list[int], cost: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Units sent from each source to each sink at the least cost, by successive shortest paths.

    ``cost`` gives the arcs; the sum of ``capacity`` must not be less than that of
    ``supply``. Ties fall to the arc of smaller numbers, so reruns agree.
    """
    n, m = len(supply), len(capacity)
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # head, room, cost, reverse
    source, sink = n + m, n + m + 1

    def arc(u: int, v: int, room: int, c: int) -> list[int]:
        graph[u].append([v, room, c, len(graph[v])])
        graph[v].append([u, 0, -c, len(graph[u]) - 1])
        return graph[u][-1]

    for i, x in enumerate(supply):
        arc(source, i, x, 0)
    for j, x in enumerate(capacity):
        arc(n + j, sink, x, 0)
    arcs = {(i, j): arc(i, n + j, supply[i], c) for (i, j), c in sorted(cost.items())}
    left, potential = sum(supply), [0] * len(graph)
    while left:
        distance, parent, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            for k, (v, room, c, _) in enumerate(graph[u]):
                if room and (e := d + c + potential[u] - potential[v]) < distance.get(v, e + 1):
                    distance[v], parent[v] = e, (u, k)
                    heapq.heappush(heap, (e, v))
        if sink not in parent:
            raise ValueError("the capacities are too small")
        most = max(distance.values())
        for v in range(len(graph)):
            potential[v] += distance.get(v, most)
        push, v = left, sink
        while v != source:
            u, k = parent[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = parent[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
        left -= push
    return {key: supply[key[0]] - a[1] for key, a in arcs.items() if supply[key[0]] - a[1]}


def _cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): the stretch of each old shard that goes to a new one; what stays comes first."""
    out, at = [], {}
    for old, new in sorted(flow, key=lambda x: (x[0], x[0] != x[1], x[1])):
        start = at.get(old, 0)
        out.append((old, new, start, start + flow[old, new]))
        at[old] = start + flow[old, new]
    return out


def _placed(rows: DataFrame, flow: dict[tuple[int, int], int]) -> DataFrame:
    """``shard`` for rows with (old, draw, size), cut where a document's middle falls."""
    spark = rows.sparkSession
    blocked = rows.withColumn("block", F.pmod("draw", F.lit(BLOCKS)))
    starts = blocked.groupBy("old", "block").agg(F.sum("size").alias("bytes")).withColumn("start", F.coalesce(F.sum("bytes").over(Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bytes")
    inside = Window.partitionBy("old", "block").orderBy("draw", "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    cuts = _cuts(flow)
    last = {old: k for k, (old, *_) in enumerate(cuts)}
    table = small_table(spark, [(o, n, float(a), 1e300 if last[o] == k else float(b)) for k, (o, n, a, b) in enumerate(cuts)] or [(-1, -1, 0.0, 0.0)], "old int, shard int, low double, high double")
    found = blocked.join(starts, ["old", "block"]).withColumn("middle", middle)
    # a few stretches for each old shard: no more than old plus new shards in all
    return found.join(F.broadcast(table), ["old"]).where("middle >= low and middle < high").drop("middle", "low", "high", "start")


def shard_plan(documents: DataFrame, shards: int = 40, old: Column | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, size, text_crc32, law, old_shard, shard, slot, grown_shard.

    Law `bytes`: the new shards' sizes are near equal. A document's size is the UTF-8
    bytes of its text, null having none, plus 16; text_crc32 of a null text is null.
    ``old`` names the present shard of each row (default: the file it was read from;
    rows from no file are one shard). Old shard k, in order of names, is also new
    shard k while k < ``shards``: what stays there does not move. Slots count from 0
    in each shard without gaps. Rows alike in all of these are exchanged freely: the
    law evens out bytes alone, so rows of equal texts (equal text_crc32) are placed
    each for itself, in one shard or several. A text of any length is one row of its
    shard; other columns play no part. An empty table gives an empty table.
    """
    spark = documents.sparkSession
    sized = documents.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), (F.input_file_name() if old is None else old).cast("string").alias("name"))
    sized = written(sized.withColumn("draw", F.xxhash64("doc_id", "crc", "size")), "sizes")
    by_name = sized.groupBy("name").agg(F.sum("size").alias("bytes")).orderBy(F.col("name").asc_nulls_last()).collect()  # one row for each old shard
    total = sum(x.bytes for x in by_name)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    # old shards beyond the new ones have nothing that can stay: they are one source
    supply = [x.bytes for x in by_name[:shards]] + ([sum(x.bytes for x in by_name[shards:])] if len(by_name) > shards else [])
    number = small_table(spark, [(x.name, min(k, shards)) for k, x in enumerate(by_name)] or [("", 0)], "name string, old int")
    numbered = sized.join(number.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name"))).drop("name", "_name")
    rank = sum((F.col("size") <= max(1, total // shards // part)).cast("int") for part in CLASSES)
    numbered = numbered.withColumn("class", rank)
    sums = {(x["class"], x.old): x.bytes for x in numbered.groupBy("class", "old").agg(F.sum("size").alias("bytes")).collect()}
    classes = sorted({c for c, _ in sums})
    every = numbered.withColumn("block", F.lit(0)).withColumn("shard", F.lit(0)).limit(0) if not classes else None
    for c in classes:
        flow = min_cost_flow(supply, capacity, {(i, j): int(i != j) for i in range(len(supply)) for j in range(shards)})
        share = {k: v if c == classes[-1] else v * sums.get((c, k[0]), 0) // supply[k[0]] for k, v in flow.items()}
        placed = written(_placed(numbered.where(F.col("class") == c), share), "placed")
        if c != classes[-1]:
            for x in placed.groupBy("old", "shard").agg(F.sum("size").alias("bytes")).collect():  # a few numbers for each old shard
                supply[x.old] -= x.bytes
                capacity[x.shard] -= x.bytes
            capacity = [max(0, x) for x in capacity]
        every = placed if every is None else every.unionByName(placed)
    counts = every.groupBy("shard", "old", "class", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("old", "class", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "old", "class", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    slot = F.col("first") + F.row_number().over(Window.partitionBy("shard", "old", "class", "block").orderBy("draw", "doc_id", "size", "crc")) - 1
    return every.join(starts, ["shard", "old", "class", "block"]).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("old").alias("old_shard"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published manifests, ascending. One that was not written to its end has no mark of success."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [x.getPath() for x in fs.listStatus(folder)]
    return sorted(int(x.getName().partition("=")[2]) for x in found if x.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def reshard(documents: DataFrame, path: str, shards: int = 40, old: Column | None = None) -> DataFrame:
    """Rewrites the shards that lose or gain documents and publishes a manifest; returns the plan.

    The documents of those shards go to a folder of a new version under ``path``/data,
    in order of their slots; a shard that neither loses nor gains is left in its file,
    and the manifest names that file. Without files as old shards (``old`` given) all
    shards are written. The manifest is written last: until then readers see the
    version before. A run that broke off leaves a folder that no manifest names, which
    the next run overwrites; a run on an unchanged plan writes nothing. ``read_shards``
    finds each row of ``documents`` once. Column names may be any.
    """
    spark = documents.sparkSession
    plan = written(shard_plan(documents, shards, old), "plan")
    mark = plan.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(doc_id, size, text_crc32, shard, slot))").alias("x")).first()
    sums = {x.shard: x for x in plan.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max(F.when(F.col("old_shard") != F.col("shard"), 1).otherwise(0)).alias("gains")).collect()}  # a row for each shard
    names = [x.name for x in documents.select(F.input_file_name().alias("name")).distinct().orderBy(F.col("name").asc_nulls_last()).collect()]  # the old shards, numbered as in the plan
    loses = {x.old_shard for x in plan.where("old_shard <> shard").select("old_shard").distinct().collect()}
    kept = {k for k, x in sums.items() if old is None and k < len(names) and names[k] and not x.gains and k not in loses}
    versions = _versions(spark, path)
    print_of = f"{mark.n} {mark.x}"
    if versions and spark.read.parquet(f"{path}/manifest/version={versions[-1]}").where(F.col("plan") == print_of).limit(1).count():
        return plan
    version = (versions[-1] if versions else 0) + 1
    shard = free_name(documents, "shard")
    key = ["_doc", "_size", "_crc", "_copy"]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    keyed = rows.select("row", F.col("row.doc_id").alias("_doc"), (F.coalesce(F.octet_length("row.text"), F.lit(0)) + OVERHEAD).cast("long").alias("_size"), F.crc32(F.col("row.text").cast("binary")).alias("_crc"))
    keyed = keyed.withColumn("_copy", F.row_number().over(Window.partitionBy("_doc", "_size", "_crc").orderBy(F.xxhash64("row"))))
    wanted = plan.where(~F.col("shard").isin(*kept)) if kept else plan
    placed = plan.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("shard", "slot"))).join(wanted.select("shard", "slot"), ["shard", "slot"], "left_semi")
    placed = placed.select(F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "_copy", F.col("shard").alias("_shard"), "slot")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in key]
    moved = keyed.alias("k").join(placed.alias("p"), same).select("row", "_shard", "slot").repartitionByRange("_shard", "slot").sortWithinPartitions("_shard", "slot")
    moved.select("row.*", F.col("_shard").alias(shard)).write.mode("overwrite").partitionBy(shard).parquet(f"{path}/data/version={version}")
    manifest = [(k, names[k] if k in kept else f"{path}/data/version={version}/{shard}={k}", shard, x.n, x.bytes, print_of) for k, x in sorted(sums.items())]
    small_table(spark, manifest, "shard int, folder string, column string, rows long, bytes long, plan string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return plan


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the newest manifest under ``path``, with the number of their shard."""
    rows = spark.read.parquet(f"{path}/manifest/version={_versions(spark, path)[-1]}").collect()  # a row for each shard
    parts = [spark.read.parquet(x.folder).withColumn(x.column, F.lit(x["shard"])) for x in rows]
    return reduce(DataFrame.unionByName, parts)
