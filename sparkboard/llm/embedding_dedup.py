"""Near duplicates among embeddings: spherical k-means cells, blocked cosine products.

Only rows with equal, non-null labels are compared. Equal vectors are one point with
a count. Each label with more than ``CELL`` points gets cells by spherical k-means,
fitted on a bounded sample; every point goes to the cell of its nearest centroid and
also, as a guest, to each cell whose border is so near that a partner may lie beyond
it: two unit vectors with cosine t or more are sqrt(2 - 2t) apart at most, so one of
them is within half of that of the plane between their cells. So no pair is lost.
Cells are compared in blocks of ``BLOCK`` points by matrix products in double
precision. A block returns link counts and the links that join its groups, no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, small_table, written

CELL, BLOCK = 2048, 1024
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CELLS = 20_000, 64 << 20, 1024  # the fit's bounds


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of the unit rows of ``x``; the first ones are spread over its rows."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ centroids.T, axis=1)
        for c in np.unique(home):
            mean = x[home == c].sum(axis=0)
            if norm := np.linalg.norm(mean):
                centroids[c] = mean / norm
    return centroids


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cells(broadcast, reach: float):
    def run(batches):
        fitted = broadcast.value
        for batch in batches:
            group, size = batch.column("grp").to_pylist(), batch.column("dim").to_pylist()
            home, guest = np.zeros(len(batch), np.int64), [[] for _ in group]
            by: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(group, size, strict=True)):
                if key in fitted:
                    by.setdefault(key, []).append(i)
            for key, rows in by.items():
                centroids, gaps = fitted[key]
                x = _unit(_matrix(batch.column("vec").take(pa.array(rows))))
                near = x @ centroids.T
                own = np.argmax(near, axis=1)
                margin = near[np.arange(len(rows)), own][:, None] - near
                visits = margin <= reach * gaps[own] + 1e-9
                visits[np.arange(len(rows)), own] = False
                home[rows] = own
                for r, i in enumerate(rows):
                    guest[i] = np.flatnonzero(visits[r]).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "mult", "grp", "dim", "vec")), pa.array(home), pa.array(guest, pa.list_(pa.int64()))], names=["rep", "mult", "grp", "dim", "vec", "home", "guest"])

    return run


def _linked(threshold: float):
    def exact(a: np.ndarray, b: np.ndarray) -> bool:
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        dot = lambda p, q: math.fsum((p * q).tolist())
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))) >= threshold

    def run(table: pa.Table) -> pa.Table:
        ids, mult = table.column("rep").to_numpy(), table.column("mult").to_numpy()
        side, home = table.column("side").to_numpy(), table.column("home").to_numpy()
        cell = int(table.column("cell")[0].as_py())
        raw = _matrix(table.column("vec"))
        unit = _unit(raw)
        first = side == side.min()
        one = len(np.unique(side)) == 1
        a, b = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(first), np.flatnonzero(~first))
        product = unit[a] @ unit[b].T
        linked = product >= threshold
        for i, j in np.argwhere(np.abs(product - threshold) < 1e-9):
            linked[i, j] = exact(raw[a[i]], raw[b[j]])
        if one:
            np.fill_diagonal(linked, False)
            if home[0] != cell:  # guests alone: the home side is not there
                linked[:] = False
        elif (home[b] != cell).any() or (home[a] != cell).any():  # guests against the cell's own; a pair that meets in two cells counts in the lower one
            guests, own, by_guest = (a, b, linked) if (home[a] != cell).any() else (b, a, linked.T)
            visits = table.column("guest").take(pa.array(own)).to_pylist()
            for g in np.unique(home[guests]).tolist():
                if g < cell:
                    twice = np.array([g in v for v in visits])
                    by_guest[np.ix_(home[guests] == g, twice)] = False
        counts = np.zeros(len(ids), np.int64)
        np.add.at(counts, a, linked @ mult[b])
        if not one:
            np.add.at(counts, b, linked.T @ mult[a])
        group, links = np.arange(len(ids)), []
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            near = b[linked[i]]
            roots, at = np.unique(group[near], return_index=True)
            for root, k in zip(roots.tolist(), near[at].tolist(), strict=True):
                if root != group[a[i]]:
                    links.append((int(ids[a[i]]), int(ids[k])))
                    group[group == root] = group[a[i]]
        some = np.flatnonzero(counts)
        return pa.table({"a": pa.array([*ids[some].tolist(), *(x for x, _ in links)], pa.int64()), "b": pa.array([None] * len(some) + [y for _, y in links], pa.int64()), "n": pa.array([*counts[some].tolist(), *[0] * len(links)], pa.int64())})

    return run


def embedding_groups(embeddings: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    n_links counts the other rows linked directly (cosine of ``threshold`` or more in
    double precision, equal labels), component_id is the smallest id reachable by
    links, itself included, and the row with that id is kept. A row whose label,
    vector or id is null, whose vector is empty, zero or holds null or non-finite
    components links with nothing, and neither do vectors of different lengths.
    Repeated rows link with each other. Other columns play no part; an empty table
    gives an empty table.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("grp"), F.col(vector_column).cast("array<double>").alias("vec"))
    sound = F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    points = written(rows.where("sound").groupBy("grp", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.size("vec")), "points")
    # labels large enough for cells: at most one for each CELL points, the largest MOST_CELLS of them
    large = points.groupBy("grp", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL).orderBy(F.desc("n"), "grp", "dim").limit(MOST_CELLS).collect()
    fitted: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}  # centroids and their distances
    if large:
        every, dim = sum(x.n for x in large), max(x.dim for x in large)
        rows_wanted = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        share = min(1.0, rows_wanted / every)
        wanted = small_table(spark, [(x.grp, x.dim) for x in large], "grp string, dim int")
        drawn = points.join(F.broadcast(wanted), ["grp", "dim"]).where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000)).select("grp", "dim", "rep", "vec").limit(2 * rows_wanted).collect()
        by: dict[tuple[str, int], list] = {}
        for x in sorted(drawn, key=lambda x: x.rep):
            by.setdefault((x.grp, x.dim), []).append(x.vec)
        for x in large:
            own = by.get((x.grp, x.dim), [])
            k = min(-(-x.n // CELL), len(own) // 8, max(1, MOST_CELLS * x.n // every))
            if k > 1:
                centroids = spherical_kmeans(_unit(np.array(own)), k)
                fitted[x.grp, x.dim] = centroids, np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    placed = written(points.mapInArrow(_cells(spark.sparkContext.broadcast(fitted), reach), "rep long, mult long, grp string, dim int, vec array<double>, home long, guest array<long>"), "cells")
    count = lambda df: df.groupBy("grp", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("n"))
    own = placed.withColumn("cell", F.col("home"))
    guests = placed.withColumn("cell", F.explode("guest"))
    own_n, guest_n = count(own).withColumnRenamed("n", "own_n"), count(guests).withColumnRenamed("n", "guest_n")
    sizes = own_n.join(guest_n, ["grp", "dim", "cell"], "left").withColumn("guest_n", F.coalesce("guest_n", F.lit(0).cast("long")))
    sized = lambda df, n: df.join(sizes, ["grp", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col(n)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    inner = F.transform(upto("own_n"), lambda j: F.struct(F.lit(0).alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"), F.col("block").alias("side")))
    outer = F.when(F.col("guest_n") > 0, F.transform(upto("guest_n"), lambda g: F.struct(F.lit(1).alias("kind"), F.col("block").alias("i"), g.alias("j"), F.lit(-1).cast("long").alias("side")))).otherwise(F.array().cast("array<struct<kind:int,i:bigint,j:bigint,side:bigint>>"))
    visits = F.transform(upto("own_n"), lambda j: F.struct(F.lit(1).alias("kind"), j.alias("i"), F.col("block").alias("j"), F.lit(-2).cast("long").alias("side")))
    fields = ["grp", "dim", "cell", "rep", "mult", "home", "guest", "vec"]
    jobs = sized(own, "own_n").select(*fields, F.explode(F.concat(inner, outer)).alias("t")).unionByName(sized(guests, "guest_n").select(*fields, F.explode(visits).alias("t")))
    jobs = jobs.select(*fields, "t.kind", "t.i", "t.j", "t.side")
    found = written(jobs.groupBy("grp", "dim", "cell", "kind", "i", "j").applyInArrow(_linked(threshold), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    groups = components(found.where("b is not null").select("a", "b"))
    named = points.join(counts, points["rep"] == counts["a"], "left").join(groups, points["rep"] == groups["node"], "left")
    # rows find their point by two hashes of the vector, 128 bits, so no vector is shuffled here
    marks = [F.xxhash64("vec").alias("h"), F.xxhash64(F.lit("second"), "grp", "vec").alias("h2")]
    named = named.select("grp", *marks, (F.coalesce("links", F.lit(0).cast("long")) + F.col("mult") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    matched = rows.where("sound").select("id", "grp", *marks).join(named, ["grp", "h", "h2"]).select("id", "links", "component")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = matched.unionByName(alone)
    return out.select(F.col("id").alias(id_column), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
