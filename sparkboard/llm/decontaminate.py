"""Benchmark decontamination with an FM-index for each shard of the training texts.

The windows of the benchmark items are the stated query set, broadcast in blocks
of a checked size. A shard is ``SHARD_BYTES`` of consecutive texts. Its words become
numbers of the benchmark's vocabulary; words that no item has cannot be part of a
match and end a run, and runs too short for any window are left out. The others are
the shard's sequence, over which one index is built. Backward
search finds all windows at once, sampled suffix positions locate every occurrence,
and overlapping occurrences merge into removal spans. A text lies in one shard
whole, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .fm_index import FMIndex
from .shared import free_name, give_back, small_batches

BLOCK_BYTES = 1 << 20  # of benchmark text that is searched, and in a worker's memory, at once
SHARD_BYTES = 8 << 20  # of training text that one index covers; a longer text is a shard of its own
SHARD_WORDS = 1 << 19
_FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"
_CUT = "struct<n_words:long,n_hit:long,rest:string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """The windows of a block of items, as numbers of their vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        texts = pa.array([x[1] for x in items], pa.large_binary())
        data, offsets = wh.buffers(texts)
        first, _, _, hashes = wh.words(data, offsets, "alnum")
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes) + 1
        self.ids = sorted({x[0] for x in items})
        number = {x: k for k, x in enumerate(self.ids)}
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (item, _) in enumerate(items):
            own = numbers[first[k] : first[k + 1]].tolist()
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(number[item])
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for phrase in found:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.phrases = {n: np.array(sorted(x), np.int64) for n, x in sorted(by_length.items())}
        self.items = {n: [np.array(sorted(found[tuple(p)]), np.int64) for p in x.tolist()] for n, x in self.phrases.items()}
        self.least = min(self.phrases, default=0)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.likely[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes[maybe]
        out[maybe[known]] = at[known] + 1
        return out


def _runs(numbers: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least ``least`` known words inside one text."""
    known = numbers > 0
    before = np.zeros(len(known), bool)
    before[1:] = known[:-1]
    before[first[:-1][first[:-1] < len(known)]] = False
    starts = np.flatnonzero(known & ~before)
    after = np.zeros(len(known), bool)
    after[:-1] = known[1:] & before[1:]
    ends = np.flatnonzero(known & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _search(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, word of each occurrence, its phrase) over shards of the runs."""
    total = np.cumsum(ends - starts + 1)
    a = 0
    while a < len(starts):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + SHARD_WORDS, "right")))
        lengths = ends[a:b] - starts[a:b] + 1
        offset = np.cumsum(lengths) - lengths
        word = np.arange(lengths.sum()) + np.repeat(starts[a:b] - offset, lengths)
        seq = numbers[np.minimum(word, len(numbers) - 1)].astype(np.int64)
        seq[offset + lengths - 1] = 0
        index = FMIndex(seq, len(p.vocabulary))
        for n, phrases in p.phrases.items():
            low, high = index.find(phrases)
            counts = high - low
            which = np.repeat(np.arange(len(phrases)), counts)
            rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            for i in range(0, len(rows), SHARD_WORDS):
                yield n, word[index.locate(rows[i : i + SHARD_WORDS])], which[i : i + SHARD_WORDS]
        a = b


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans with those that touch or overlap merged."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, np.int64)
    return start[new], reach[last]


def _one_shard(data: np.ndarray, offsets: np.ndarray, p: Phrases, spans: list | None, items: list | None) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    n = len(offsets) - 1
    n_words, parts, bounds = np.zeros(n, np.int64), [], [np.zeros(1, np.int64)]
    for i, j in wh.blocks(offsets):
        first, _, _, hashes = wh.words(data, offsets[i : j + 1], "alnum")
        n_words[i:j] = np.diff(first)
        parts.append(p.numbers(hashes))
    first = np.concatenate([*bounds, np.cumsum(n_words)])
    numbers = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    starts, ends = _runs(numbers, first, p.least)
    at, to, doc_items = [], [], []
    for length, word, which in _search(numbers, starts, ends, p):
        at.append(word)
        to.append(word + length)
        doc = np.searchsorted(first, word, "right") - 1
        pairs = np.unique(doc * len(p.phrases[length]) + which)
        own = [p.items[length][k] for k in (pairs % len(p.phrases[length])).tolist()]
        if own:
            doc_items.append(np.stack([np.repeat(pairs // len(p.phrases[length]), [len(x) for x in own]), np.concatenate(own)]))
    new_items: list[list[str]] = items or [[] for _ in range(n)]
    if doc_items:
        for d, k in np.unique(np.concatenate(doc_items, axis=1), axis=1).T.tolist():
            new_items[d].append(p.ids[k])
    if spans:
        old = np.array([(first[d] + x, first[d] + y) for d, own in enumerate(spans) for x, y in own], np.int64).reshape(-1, 2)
        at.append(old[:, 0])
        to.append(old[:, 1])
    a, b = np.concatenate(at) if at else np.zeros(0, np.int64), np.concatenate(to) if to else np.zeros(0, np.int64)
    doc = np.searchsorted(first, a, "right") - 1
    shift = doc  # keeps spans of neighbouring texts apart while they are merged
    a, b = _union(a + shift, b + shift)
    merged: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    owner = np.searchsorted(first + np.arange(n + 1), a, "right") - 1
    for d, x, y in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True):
        merged[d].append((x - d - int(first[d]), y - d - int(first[d])))
    return n_words, merged, [sorted(set(x)) for x in new_items]


def _shards(texts: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
    """Consecutive batches of texts that hold about ``SHARD_BYTES``."""
    held, size = [], 0
    for column in texts:
        held.append(column)
        size += column.nbytes
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cut(text: pa.Scalar, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of ``spans``, from the first of each to its last."""
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    _, starts, ends, _ = wh.words(raw, np.array([0, len(raw)]), "alnum")
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : starts[a]].tobytes())
        at = int(ends[b - 1])
    return b"".join(kept) + raw[at:].tobytes()


def _searched(benchmark: DataFrame, window: int, item_column: str, item_text: str, cut: bool) -> Callable[[Column], Column]:
    """A function of a text column: struct(n_words, spans, items), with ``cut`` struct(n_words,
    n_hit, rest), where rest is what stays of a text that is hit, else null."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text).cast("binary"), F.lit(b"")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    parts = max(1, -(-int(size) // BLOCK_BYTES))
    blocks = []
    for k in range(parts):  # blocks of the query set, each small enough to be broadcast
        block = items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).collect()
        blocks.append(spark.sparkContext.broadcast(Phrases([(x.i, bytes(x.t)) for x in block], window)))

    @F.arrow_udf(_CUT if cut else _FOUND)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for shard in _shards(texts):
            whole = pa.concat_arrays(shard).cast(pa.large_binary())
            data, offsets = wh.buffers(whole)
            n_words = spans = items = None
            for b in blocks:  # one block at a time is in memory, whatever their number
                n_words, spans, items = _one_shard(data, offsets, b.value if len(blocks) == 1 else b.load_from_path(b._path), spans, items)
            if cut:
                n_hit = [sum(b - a for a, b in own) for own in spans]
                rest = [_cut(whole[k], own) if own else None for k, own in enumerate(spans)]
                out = [pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array(rest, pa.binary()).cast(pa.string())]
                names = ["n_words", "n_hit", "rest"]
            else:
                out = [pa.array(n_words), pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], _SPANS), pa.array(items, pa.list_(pa.string()))]
                names = ["n_words", "spans", "items"]
            found, at = pa.StructArray.from_arrays(out, names), 0
            for column in shard:
                yield found.slice(at, len(column))
                at += len(column)
            del whole, data, found, out
            give_back()  # an index and its search take several times a shard's size

    return lambda text: search(text.cast("string"))


def phrase_hits(documents: DataFrame, benchmark: DataFrame, keep: list[str], window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """row (struct of the columns ``keep`` of ``documents``), n_words, spans (merged
    word positions [start, end) inside any occurrence), items (sorted ids).

    Words are lower-cased runs of ASCII letters, digits and characters beyond
    ASCII. An item with fewer words than ``window`` is one window; one without
    words, or null, has none. A null or empty text has no words; a text of any
    length lies in one shard whole. Repeated items with one id count once; a null id
    is written as an empty string. Repeated rows of ``documents`` come out as often.
    Column names of ``documents`` cannot clash with the new ones: they stay inside
    ``row``. An empty benchmark leaves all spans empty, an empty table gives an empty table.
    """
    search = _searched(benchmark, window, item_column, item_text, cut=False)
    found = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), search(F.col(f"`{text_column}`")).alias("found"))
    return found.select("row", "found.n_words", "found.spans", "found.items")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text") -> DataFrame:
    """``documents`` without the benchmark passages: each merged span, from its first
    word to its last, is cut out of the text; a text of which no word is left goes.
    Texts without a hit stay as they are, null and empty ones too; so do all other
    columns, whatever their names. Repeated rows stay repeated; an empty benchmark
    changes nothing; an empty table gives an empty table."""
    search = _searched(benchmark, window, "item_id", "text", cut=True)
    own, c = [F.col(f"`{c}`") for c in documents.columns], free_name(documents, "found")
    found = documents.select(*own, search(F.col(f"`{text_column}`")).alias(c)).where((F.col(c)["n_hit"] == 0) | (F.col(c)["n_hit"] < F.col(c)["n_words"]))
    kind = dict(documents.dtypes)[text_column]
    rest = F.when(F.col(c)["n_hit"] == 0, F.col(f"`{text_column}`")).otherwise(F.col(c)["rest"].cast(kind))
    return found.select(*[rest.alias(x) if x == text_column else F.col(f"`{x}`") for x in documents.columns])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = phrase_hits(documents, benchmark, ["doc_id"], window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return hits.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
