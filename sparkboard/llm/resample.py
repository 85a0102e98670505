"""Importance resampling towards a target text, over hashed n-grams of words.

Texts are read in chunks of about 4 MB. A chunk has an integer dictionary: each distinct
word gets an id, an n-gram is the tuple of its words' ids, and each distinct tuple's
UTF-8 bytes, made again from the dictionary, are hashed once; counts, and later gains, are
joined back to the tuple's occurrences. So words are compared exactly, hashing costs one
pass over distinct tuples, and no word is shuffled: tasks send on one count for each bucket.
A dictionary of the whole corpus would ship each of its words to a join twice.

A bucket's gain is the log of its share in the target over its share in the corpus. A
document's weight is the mean gain of its n-grams; with Gumbel noise, which is a hash of its
id, the highest scores are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranked
from . import wordhash as wh
from .shared import small_batches, written

BUCKETS = 10_000
PIECE = 4 << 20  # bytes of text with one dictionary
_SHORT = 32  # bytes; the CRC of longer words is taken one by one
_U32 = np.uint32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=_U32)
    for _ in range(8):
        t = (t >> _U32(1)) ^ (_U32(0xEDB88320) * (t & _U32(1)))  # fixed value: the polynomial of CRC-32
    return t


_CRC = _crc_table()


class Dictionary:
    """Distinct words of a chunk, in ids from 0, with their bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """``data``: bytes in lower case; word k is data[starts[k]:ends[k]]."""
        n = len(starts)
        kept = data[wh.TABLES["alnum"][1][data]]  # the words' bytes, one after the other
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.size = len(coded.dictionary)
        self.bytes, self.offsets = wh.buffers(coded.dictionary)
        self.lengths = np.diff(self.offsets)
        self.states = self.fed(np.full(self.size, 0xFFFFFFFF, _U32), np.arange(self.size))

    def fed(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """CRC-32 registers after the bytes of the words ``ids``."""
        states, lengths = states.copy(), self.lengths[ids]
        for k in np.flatnonzero(lengths > _SHORT).tolist():
            word = self.bytes[self.offsets[ids[k]] : self.offsets[ids[k] + 1]].tobytes()
            states[k] = zlib.crc32(word, int(states[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        at, own = np.flatnonzero(lengths <= _SHORT), self.offsets[:-1][ids]
        for j in range(_SHORT):
            at = at[lengths[at] > j]
            if not len(at):
                break
            s = states[at]
            states[at] = _CRC[(s ^ self.bytes[own[at] + j]) & _U32(255)] ^ (s >> _U32(8))
        return states

    def buckets(self, states: np.ndarray, buckets: int) -> np.ndarray:
        return ((states ^ _U32(0xFFFFFFFF)) % _U32(buckets)).astype(np.int64)

    def pairs(self, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the distinct pairs of ids that start at the words ``first``, and which pair each is."""
        coded = pa.array(self.ids[first] * self.size + self.ids[first + 1]).dictionary_encode()
        distinct = coded.dictionary.to_numpy()
        left, right = distinct // self.size, distinct % self.size
        s = self.states[left]
        s = _CRC[(s ^ _U32(0x20)) & _U32(255)] ^ (s >> _U32(8))
        return self.buckets(self.fed(s, right), buckets), coded.indices.to_numpy()


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, starts and ends of words; none goes across ``cuts``."""
    letters, is_word = wh.TABLES["alnum"]
    inside = is_word[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return letters[data], np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(first text, bytes, starts, ends, first word of each text, whether the last text goes on) by chunk.

    A text beyond ``size`` bytes comes in pieces that end with a word with which the next
    piece starts again: so no pair is lost, and that word counts in the next piece.
    """
    is_word = wh.TABLES["alnum"][1]
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        at, stop = int(offsets[i]), int(offsets[j])
        while True:
            end = stop
            if j == i + 1 and stop - at > size:
                end = at + size
                while end < stop and is_word[data[end]]:
                    end += 1
            low, starts, ends = _words(data[at:end], offsets[i : j + 1] - at)
            while end < stop and len(starts) < 2:  # words of more than a piece
                end = min(stop, end + size)
                while end < stop and is_word[data[end]]:
                    end += 1
                low, starts, ends = _words(data[at:end], offsets[i : j + 1] - at)
            bounds = np.searchsorted(starts, np.clip(offsets[i : j + 1] - at, 0, None))
            bounds[-1] = len(starts)
            yield i, low, starts, ends, bounds, end < stop
            if end == stop:
                break
            at += int(starts[-1])
        i = j


def _chunks(column: pa.Array) -> Iterator[tuple[int, Dictionary, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, dictionary, first word of each text, words that count, words that start a pair)"""
    data, offsets = wh.buffers(column)
    for i, low, starts, ends, bounds, goes_on in pieces(data, offsets):
        single = np.ones(len(starts), bool)
        double = np.ones(len(starts), bool)
        double[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False
        if goes_on:
            single[-1] = False
        yield i, Dictionary(low, starts, ends), bounds, single, np.flatnonzero(double)


def _counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, words, _, single, double in _chunks(batch.column(0)):
                own = np.bincount(words.ids[single], minlength=words.size)
                total += np.bincount(words.buckets(words.states, buckets), own, buckets).astype(np.int64)
                found, which = words.pairs(double, buckets)
                total += np.bincount(found, np.bincount(which, minlength=len(found)), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): words and pairs of all texts of the one column of ``texts``, by bucket."""
    small_batches(texts.sparkSession)
    return texts.mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) by bucket, with one added to each count."""
    buckets = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weighed(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            n_pairs, total = n_words.copy(), n_words.copy()
            for i, words, bounds, single, double in _chunks(batch.column(1)):
                each = np.where(single, gain[words.buckets(words.states, len(gain))[words.ids]], 0)
                found, which = words.pairs(double, len(gain))
                each[double] += gain[found[which]]
                ones = np.zeros(len(single), np.int64)
                ones[double] = 1
                at = slice(i, i + len(bounds) - 1)
                for out, values in ((total, each), (n_words, single.astype(np.int64)), (n_pairs, ones)):
                    sums = np.concatenate([[0], np.cumsum(values)])
                    out[at] += sums[bounds[1:]] - sums[bounds[:-1]]
            features = n_words + n_pairs
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _by_bucket(counts: DataFrame, buckets: int) -> np.ndarray:
    """``counts`` as an array: as many numbers as there are buckets, a parameter."""
    out, table = np.zeros(buckets, np.int64), counts.toArrow()
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), with u from the first 32 bits of the SHA-256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def resampled(documents: DataFrame, target: DataFrame, share: int = 25, least: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for every row of ``documents``, to draw ``share`` in 100
    of those that have ``least`` words, towards the texts of ``target``.

    rank is 1, 2, 3 and so on from the highest score, ties to the smaller doc_id; it is null for
    rows not drawn. Null and empty texts have no features and weight 0. A null doc_id is hashed as
    an empty text and loses ties. Repeated rows count each time and have a rank each; rows of one id
    that tie are ordered by features and weight. Texts count whole, whatever their length;
    only doc_id and text are read, so other columns may have any name. Without documents
    there are no rows; without target texts every bucket's target count is 0.
    """
    small_batches(documents.sparkSession)
    own = [_by_bucket(bucket_counts(t.select(F.col("text").cast("string").alias("x")), buckets), buckets) for t in (documents, target)]
    kind = documents.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_features long, weight long"
    rows = documents.select("doc_id", F.col("text").cast("string").alias("x")).mapInArrow(_weighed(gains(*own)), schema)
    scored = rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored.withColumn("fit", F.col("n_words") >= least), "scores")
    fit = scored.agg(F.count_if("fit")).first()[0]
    placed = ranked(scored, [("fit", "desc"), ("score", "desc"), ("doc_id", "asc_nulls_last"), "n_features", "weight"], name="rank")
    return placed.withColumn("rank", F.when(F.col("fit") & (F.col("rank") <= share * fit // 100), F.col("rank"))).drop("fit")
