"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles. A shingle weighs its count in
the text times an inverse document frequency over the whole corpus, clipped where
fewer than one document in ``RARE`` has it; only shingles above that line need a
count of their own, at most ``RARE`` times the mean number of shingles a text has,
and never more than ``TABLE``. They are found exactly in two passes: whatever is
that frequent in the corpus is so in some task's texts (lossy counting in each
task), and the candidates are then counted over all texts.

Improved consistent weighted sampling gives each text ``BANDS * ROWS`` samples,
banded into keys. Texts with equal words are one class from the start. Classes that
share a key are compared by exact weighted Jaccard similarity in blocks; a block
returns the links that join its groups, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import components, free_name, give_back, released, small_batches, written

SHINGLE, BANDS, ROWS = 5, 12, 3
BLOCK, BLOCK_BYTES = 256, 2 << 20
MOST_BROADCAST = 1 << 18  # pairs of two numbers
RARE, TABLE = 256, 1 << 18
IDF_STRENGTH = 0.25
CANDIDATES = 1 << 21  # counted in one pass
_U = np.uint64


def _shingles(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: word hashes, and shingle hashes in order. Fewer than five words are one shingle."""
    for i, j in wh.blocks(offsets):
        first, _, _, hashes = wh.words(data, offsets[i : j + 1], "alnum")
        every = wh.windows(hashes, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield hashes[a:b], every[a : b - SHINGLE + 1] if b - a >= SHINGLE else wh.windows(hashes[a:b], b - a)[: b > a]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lossy counting: the shingles that can be frequent, with the task's totals in a row of hash null."""
    keys, counts, missed = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.float64)
    docs = total = 0
    bound, waiting, held = 0.0, [], 0

    def settle() -> None:
        nonlocal keys, counts, missed, bound, waiting, held
        new, n = np.unique(np.concatenate([*waiting, np.zeros(0, _U)]), return_counts=True)
        both = np.union1d(keys, new)
        at, to = np.searchsorted(both, keys), np.searchsorted(both, new)
        c, m = np.zeros(len(both), np.int64), np.full(len(both), bound)
        c[at], m[at] = counts, missed
        c[to] += n
        bound = docs / RARE + total / TABLE
        stay = c + m >= bound
        keys, counts, missed, waiting, held = both[stay], c[stay], m[stay], [], 0

    for batch in batches:
        data, offsets = wh.buffers(batch.column(0))
        for _, own in _shingles(data, offsets):
            if len(own):
                own = np.unique(own)
                docs, total, held = docs + 1, total + len(own), held + len(own)
                waiting.append(own)
                if held > 1 << 20:
                    settle()
    settle()
    yield pa.RecordBatch.from_arrays([pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array([docs] + [0] * len(keys), pa.int64()), pa.array([total] + [0] * len(keys), pa.int64())], names=["hash", "docs", "total"])


def _counted(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = broadcast.value
        likely = np.zeros(1 << 20, bool)
        likely[(wanted & _U(0xFFFFF)).astype(np.int64)] = True
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            data, offsets = wh.buffers(batch.column(0))
            for _, own in _shingles(data, offsets):
                own = own[likely[(own & _U(0xFFFFF)).astype(np.int64)]]
                if len(own):
                    own = np.unique(own)
                    at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    counts[at[wanted[at] == own]] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(counts[some])], names=["hash", "n"])

    return run


class Weights:
    """Inverse document frequencies: 1 for a shingle that is not frequent."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, docs: int, least: float, strength: float) -> None:
        order = np.argsort(keys)
        self.keys = keys[order]
        rarest = np.log(max(docs / max(least, 1.0), 1.0 + 1e-9))
        self.values = 1 - strength * (1 - np.clip(np.log(docs / np.maximum(df[order], 1)) / rarest, 0, 1)) if len(keys) else np.zeros(0)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.keys & _U(0xFFFFF)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes))
        maybe = np.flatnonzero(self.likely[(hashes & _U(0xFFFFF)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[maybe]
            out[maybe[hit]] = self.values[at[hit]]
        return out


def shingle_weights(texts: DataFrame, strength: float = IDF_STRENGTH) -> Weights:
    """Document frequencies over all ``texts`` (one column) of the frequent shingles."""
    spark = texts.sparkSession
    local = written(texts.mapInArrow(released(_local), "hash long, docs long, total long"), "shingles")
    docs, total = local.agg(F.sum("docs"), F.sum("total")).first()
    docs, total = int(docs or 0), int(total or 0)
    least = docs / RARE + total / TABLE
    candidates = local.where("hash is not null").select("hash").distinct()
    parts = max(1, -(-candidates.count() // CANDIDATES))
    keys, df = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(parts):
        part = np.sort(np.array([x.hash for x in candidates.where(F.pmod("hash", F.lit(parts)) == k).toLocalIterator()], np.int64).view(_U))
        if len(part):
            wanted = spark.sparkContext.broadcast(part)
            rows = texts.mapInArrow(released(_counted(wanted)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, least)).collect()  # no more than TABLE rows by the choice of least
            keys.append(np.array([x.hash for x in rows], np.int64))
            df.append(np.array([x.n for x in rows], np.int64))
            wanted.unpersist()
    return Weights(np.concatenate(keys).view(_U), np.concatenate(df), docs, least, strength)


@cache
def _gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2**16 quantiles of Gamma(2, 1): themselves, their inverses and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low, 1 / low, np.log(low)


def consistent_samples(hashes: np.ndarray, weights: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n samples of each of the weighted sets hashes[first[i]:first[i + 1]], none of them empty.

    A sample is the smallest ln a of improved consistent weighted sampling; that
    number depends on the element and its quantised weight alone, so it stands for both.
    """
    scale, inverse, logs = _gamma_tables()
    ln_w = np.log(weights)
    rng = np.random.default_rng(20240607)
    salts, odds = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)
    out = np.empty((len(first) - 1, n))
    for k in range(n):
        bits = ((hashes ^ salts[k]) * odds[k]).view(np.uint16).reshape(-1, 4)
        at, beta = bits[:, 3].astype(np.intp), bits[:, 1] * (1 / 65536)
        r = scale[at]
        t = np.floor(ln_w * inverse[at] + beta)
        out[:, k] = np.minimum.reduceat(logs[bits[:, 2].astype(np.intp)] - r * (t - beta + 1), first[:-1])
    return out


def _signatures(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: Weights = broadcast.value
        for batch in batches:
            data, offsets = wh.buffers(batch.column(2))
            keys, pending, rows, bands = np.zeros((len(batch), 2), _U), [], [], np.zeros((len(batch), BANDS), np.int64)
            has = np.zeros(len(batch), bool)

            def settle(pending=pending, rows=rows, bands=bands) -> None:
                if rows:
                    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in pending])])
                    hashes = np.concatenate([x for x, _ in pending])
                    samples = consistent_samples(hashes, weights.of(hashes) * np.concatenate([x for _, x in pending]), first, BANDS * ROWS)
                    parts = samples.view(_U).reshape(len(rows), BANDS, ROWS)
                    key = np.tile(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), (len(rows), 1))
                    for r in range(ROWS):
                        key = wh.mix(key ^ parts[:, :, r])
                    bands[rows] = key.view(np.int64)
                    pending.clear()
                    rows.clear()

            held = 0
            for i, (own_words, own) in enumerate(_shingles(data, offsets)):
                if len(own_words):
                    has[i] = True
                    keys[i] = wh.windows(own_words, len(own_words))[0], wh.windows(wh.mix(own_words ^ _U(0xA5A5A5A5A5A5A5A5)), len(own_words))[0]
                    values, counts = np.unique(own, return_counts=True)
                    pending.append((values, counts))
                    rows.append(i)
                    held += len(values)
                    if held > 1 << 18:
                        settle()
                        held = 0
            settle()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)), pa.array(bands[has].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), *(pa.array(keys[:, c].view(np.int64), mask=~has) for c in (0, 1)), lists], names=["id", "text_hash", "size", "k1", "k2", "bands"])

    return run


def _linked(broadcast, threshold: float):
    """Links that join the texts of a job: all its texts with each other or, where it has
    two sides, those of side 0 with those of side 1. Texts that share ``known`` are joined already."""

    def run(table: pa.Table) -> pa.Table:
        weights: Weights = broadcast.value
        data, offsets = wh.buffers(table.column("x").combine_chunks())
        ids, hashes, side = (table.column(c).to_numpy() for c in ("id", "text_hash", "side"))
        sets = []
        for _, own in _shingles(data, offsets):
            values, counts = np.unique(own, return_counts=True)
            sets.append((values, counts * weights.of(values)))
        first = np.concatenate([[0], np.cumsum([len(x) for x, _ in sets])]).astype(np.int64)
        _, number = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
        weight = np.concatenate([w for _, w in sets])
        totals = np.add.reduceat(weight, first[:-1])
        group, dense, links = np.arange(len(ids)), np.zeros(number.max() + 1), []
        known = table.column("known").combine_chunks()
        if known.null_count < len(known):
            pairs = np.stack([known.field(c).to_numpy(zero_copy_only=False) for c in ("id", "text_hash")])
            group = np.unique(pairs, axis=1, return_inverse=True)[1].ravel()
        two = len(np.unique(side)) > 1
        for a in np.lexsort((hashes, ids)).tolist():
            if two and side[a]:
                continue
            open_ = (group != group[a]) & (np.minimum(totals, totals[a]) >= (threshold - 1e-9) * np.maximum(totals, totals[a]))
            if two:
                open_ &= side == 1
            if not open_.any():
                continue
            own = slice(first[a], first[a + 1])
            dense[number[own]] = weight[own]
            common = np.add.reduceat(np.minimum(dense[number], weight), first[:-1])
            dense[number[own]] = 0
            for b in np.flatnonzero(open_ & (common >= (threshold - 1e-12) * (totals + totals[a] - common))).tolist():
                if group[a] != group[b]:
                    group[group == group[b]] = group[a]
                    links.append((a, b))
        if len(data) > BLOCK_BYTES // 4:
            del sets, number, weight, dense
            give_back()
        ends = np.array(links, np.int64).reshape(-1, 2)
        node = lambda at: pa.StructArray.from_arrays([pa.array(ids[at], pa.int64()), pa.array(hashes[at], pa.int64())], ["id", "text_hash"])
        return pa.table({"a": node(ends[:, 0]), "b": node(ends[:, 1])})

    return run


_LINK = "a struct<id:long,text_hash:long>, b struct<id:long,text_hash:long>"


def near_duplicates(documents: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text", strength: float = IDF_STRENGTH) -> DataFrame:
    """One row per row of ``documents``: id, class_id (the smallest id of its group), kept.

    Words are lower-cased runs of letters and digits; texts with the same words, or
    with a weighted Jaccard similarity of ``threshold`` or more, are linked, and a
    group holds all that links reach. A null, empty or wordless text is alone; so is
    a row with a null id (class_id null, kept). Rows with one id share their group if
    their texts are equal or linked. Texts of any length are read whole. Other columns
    play no part; an empty table gives an empty table.
    """
    out = _classes(documents, threshold, id_column, text_column, strength)
    return out.select(F.col("id").alias(id_column), F.col("class.id").alias("class_id"), F.coalesce(F.col("id") == F.col("class.id"), F.lit(True)).alias("kept"))


def _links(heads: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (a, b) between texts that share a key, enough to join all that are similar.

    The texts of a key are dealt to blocks of at most about ``BLOCK`` texts and
    ``BLOCK_BYTES``. First each block is compared in itself and with the key's pivot,
    its smallest text: one copy of a text for each key, and the copies of near equal
    texts are then joined through the pivot. Only where a key's texts are still apart
    are those outside its largest group compared with all texts of other blocks.
    """
    keyed = heads.select("id", "text_hash", "size", F.explode("bands").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.struct("id", "text_hash")).alias("pivot"), F.expr("bit_xor(xxhash64(id, text_hash))").alias("members")).where("n > 1")
    groups = groups.groupBy("n", "members", "pivot", "bytes").agg(F.min("key").alias("key"))  # the same group under several keys is compared once
    n_blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long")
    groups = written(groups.select("key", "n", "pivot", n_blocks.alias("blocks")), "keys")
    none, every = F.lit(None).cast("struct<id:bigint,text_hash:bigint>"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    member = keyed.join(groups, "key").withColumn("block", F.pmod(F.xxhash64("id", "text_hash", "key"), F.col("blocks")))
    pivots = groups.where("blocks > 1").select("pivot.*", "key", F.explode(every).alias("block"))
    own = member.select("id", "text_hash", "key", "block").union(pivots)
    jobs = own.select("id", "text_hash", F.struct("key", F.lit(0).cast("long").alias("i"), F.col("block").alias("k")).alias("job"), F.lit(0).alias("side"), none.alias("known"))

    def compared(jobs: DataFrame) -> DataFrame:
        jobs = written(jobs, "jobs")
        needed = jobs.select("id", "text_hash").distinct()
        some = texts
        if needed.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # then other texts need not be shuffled
            some = texts.join(F.broadcast(needed), ["id", "text_hash"], "left_semi")
        job = some.join(jobs.hint("shuffle_hash"), ["id", "text_hash"]).select("id", "text_hash", "x", "side", "known", "job.*")
        return written(job.groupBy("key", "i", "k").applyInArrow(_linked(weights, threshold), _LINK), "links")

    links = compared(jobs)
    large = groups.where("blocks > 1")
    if large.isEmpty():
        return links
    found = components(links)
    node = F.struct("id", "text_hash")
    placed = written(member.where("blocks > 1").withColumn("own", node).join(found, F.col("own") == F.col("node"), "left").select("id", "text_hash", "key", "blocks", "block", F.coalesce("component", "own").alias("known")), "placed")
    sizes = placed.groupBy("key", "known").agg(F.count("*").alias("n"))
    bodies = sizes.groupBy("key").agg(F.max(F.struct("n", "known")).alias("body"), F.sum("n").alias("n")).where("n > body.n")
    # written, so that the join meets the placed texts of a common key as they were read, not dealt by key
    bodies = written(bodies.select("key", F.col("body.known").alias("body"), F.ceil((F.col("n") - F.col("body.n")) / BLOCK).cast("long").alias("rests")), "bodies")
    if bodies.isEmpty():
        return links
    apart = placed.join(bodies, "key")
    rest = F.pmod(F.xxhash64("text_hash", "id", "key"), F.col("rests"))
    outside = apart.where("known <> body").select("id", "text_hash", "key", rest.alias("i"), F.explode(every).alias("k"), F.lit(0).alias("side"), "known")
    inside = apart.select("id", "text_hash", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("i"), F.col("block").alias("k"), F.lit(1).alias("side"), "known")
    more = outside.union(inside).select("id", "text_hash", F.struct("key", "i", "k").alias("job"), "side", "known")
    return links.union(compared(more))


def _classes(documents: DataFrame, threshold: float, id_column: str, text_column: str, strength: float) -> DataFrame:
    """(id, text_hash, class) of each row: class is the smallest (id, text_hash) of its group, null for a null id."""
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.xxhash64(f"`{text_column}`").alias("text_hash"), F.col(f"`{text_column}`").cast("string").alias("x"))
    weights = spark.sparkContext.broadcast(shingle_weights(rows.select("x"), strength))
    marks = written(rows.mapInArrow(released(_signatures(weights)), "id long, text_hash long, size long, k1 long, k2 long, bands array<long>"), "signatures")
    able = marks.where("id is not null and k1 is not null")
    heads = able.groupBy("k1", "k2").agg(F.min(F.struct("id", "text_hash", "size")).alias("head"), F.first("bands").alias("bands"))
    heads = written(heads.select("k1", "k2", "head.*", "bands"), "heads")
    groups = components(_links(heads, rows, weights, threshold))
    own = F.struct("id", "text_hash")
    named = heads.select("k1", "k2", own.alias("own")).join(groups, F.col("own") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "own").alias("class"))
    return marks.join(named, ["k1", "k2"], "left").select("id", "text_hash", F.when(F.col("id").isNotNull(), F.coalesce("class", own)).alias("class"))


def drop_near_duplicates(documents: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with one row of each group: that of the smallest id, and of several
    texts with this id that of the smallest hash. Rows alike in id and text become one.
    Rows with a null id stay; so do null and empty texts, each under its id. All columns
    stay, whatever their names; an empty table gives an empty table."""
    classes = _classes(documents, threshold, id_column, text_column, IDF_STRENGTH).where("id is not null")
    kept_id, kept_hash = (free_name(documents, x) for x in ("kept_id", "kept_hash"))
    kept = classes.where((F.col("id") == F.col("class.id")) & (F.col("text_hash") == F.col("class.text_hash"))).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own, i = [F.col(f"`{c}`") for c in documents.columns], F.col(f"`{id_column}`")
    known = documents.where(i.isNotNull()).select(*own, i.cast("long").alias(kept_id), F.xxhash64(f"`{text_column}`").alias(kept_hash)).dropDuplicates([kept_id, kept_hash])
    kept = kept.select(F.col("_id").alias(kept_id), F.col("_hash").alias(kept_hash))
    return known.join(kept, [kept_id, kept_hash], "left_semi").select(*own).unionByName(documents.where(i.isNull()))
