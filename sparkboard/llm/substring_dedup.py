"""Removal of passages that repeat, by level-wise doubling of repeated windows.

Level 1 hashes every window of ``window / 2**levels`` words. A window whose hash
comes up once in the corpus cannot be part of a longer repeat, so at the next
level, of twice the length, only those pairs of neighbours are joined of which
both repeat. That goes on until the asked window is reached or nothing survives.

The levels compare 44 bits of a hash: what agrees by chance there is one candidate too many,
never one too few. Windows of the full length are compared by BLAKE2b digests of 128 bits
over their words, taken from the texts at the surviving starts, so no two different
windows count as equal.

A map task hashes its texts in chunks of up to 2**20 words
and sends, to each range of hashes, the chunk's distinct hashes with a position,
sorted and coded as differences: about six bytes for a window. What a chunk finds
twice in itself it need not ask for; so a passage that holds a third of all rows
costs a range one entry for each chunk, not one for each row. Ranges send back the
positions that repeat, and the next level is made from them alone.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .shared import input_bytes, small_batches, written

POSITION_BITS = 20
PIECE = 1 << POSITION_BITS  # words of a text that are hashed as one
_U = np.uint64
_BLOBS = "key long, chunk long, kind int, blob binary"
HASHES, INDEX, KNOWN, REMOVED, STARTS = 0, 1, 2, 3, 4
NULL_ID = np.iinfo(np.int64).max  # a null doc_id counts as the largest


def _blob_table(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    key, chunk, kind, blob = zip(*rows, strict=True) if rows else ([],) * 4
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["key", "chunk", "kind", "blob"])


class _Chunk:
    """Texts, or pieces of a very long text, of up to 2**20 words."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, int, int, int, int]] = []  # doc_id, text hash, first word in the text, words, starts that count
        self.hashes: list[np.ndarray] = []
        self.n = 0

    def rows(self, chunk: int, length: int, bits: int) -> list[tuple[int, int, int, bytes]]:
        index = np.array(self.pieces, np.int64)
        hashes = np.concatenate(self.hashes)
        first = np.concatenate([[0], np.cumsum(index[:, 3])[:-1]])
        valid = np.zeros(len(hashes), bool)
        counts = np.maximum(0, index[:, 3] - length + 1)
        starts = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        valid = starts.astype(_U)
        found = wh.windows(hashes, length)[starts] if len(starts) else np.zeros(0, _U)
        low = _U((1 << POSITION_BITS) - 1)
        return [(chunk, chunk, INDEX, index.tobytes()), *_asked(chunk, (found & ~low) | valid, bits)]


def _asked(chunk: int, packed: np.ndarray, bits: int) -> list[tuple[int, int, int, bytes]]:
    """What a chunk knows to repeat by itself, and what it asks the ranges of hashes; packed holds hash before position."""
    packed, low = np.sort(packed), _U((1 << POSITION_BITS) - 1)
    top = packed & ~low
    head = np.ones(len(top), bool)
    head[1:] = top[1:] != top[:-1]
    again = ~head
    again[:-1] |= ~head[1:]
    out = [(chunk, chunk, KNOWN, wh.pack(np.sort(_by_position(packed[again]))))] if again.any() else []
    packed = packed[head]
    edges = np.searchsorted(packed, (np.arange(1, 1 << bits, dtype=_U)) << _U(64 - bits))
    return out + [(k, chunk, HASHES, wh.pack(part)) for k, part in enumerate(np.split(packed, edges)) if len(part)]


def _by_position(packed: np.ndarray) -> np.ndarray:
    """Hash before position turned into position before hash."""
    return (packed << _U(64 - POSITION_BITS)) | (packed >> _U(POSITION_BITS))


def _first_level(length: int, window: int, bits: int):
    room = PIECE - window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers, chunk = TaskContext.get().partitionId(), itertools.count(), _Chunk()

        def emit() -> pa.RecordBatch:
            nonlocal chunk
            done, chunk = chunk, _Chunk()
            return _blob_table(done.rows((task << 32) | next(numbers), length, bits))

        for batch in batches:
            ids = batch.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = wh.buffers(batch.column(2))
            for i, j in wh.blocks(offsets):
                first, _, _, hashes = wh.words(data, offsets[i : j + 1], "space")
                for k in range(j - i):
                    own = hashes[first[k] : first[k + 1]]
                    if len(own) < window:
                        continue
                    for at in range(0, len(own) - window + 1, room):  # a text of more than 2**20 words comes in pieces
                        piece = own[at : at + room + window - 1]
                        if chunk.n + len(piece) >= 1 << POSITION_BITS:
                            yield emit()
                        chunk.pieces.append((int(ids[i + k]), int(texts[i + k]), at, len(piece), min(room, len(piece) - window + 1)))
                        chunk.hashes.append(piece)
                        chunk.n += len(piece)
        if chunk.n:
            yield emit()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of a range of hashes: the positions that repeat, for each chunk. Other rows pass."""
    kinds = table.column("kind").to_numpy()
    rows: list[tuple[int, int, int, bytes]] = []
    chunks, blobs = table.column("chunk").to_numpy(), table.column("blob")
    for i in np.flatnonzero(kinds != HASHES):
        rows.append((int(chunks[i]), int(chunks[i]), int(kinds[i]), blobs[int(i)].as_py()))
    own = np.flatnonzero(kinds == HASHES)
    if len(own) > 1:
        parts = [wh.unpack(blobs[int(i)].as_py()) for i in own]
        every = np.concatenate(parts)
        low = _U((1 << POSITION_BITS) - 1)
        order = np.sort(every & ~low)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            for i, part in zip(own, parts, strict=True):
                top = part & ~low
                at = np.searchsorted(twice, top)
                hit = twice[np.minimum(at, len(twice) - 1)] == top
                if hit.any():
                    rows.append((int(chunks[i]), int(chunks[i]), KNOWN, wh.pack(np.sort(_by_position(part[hit])))))
    return pa.Table.from_batches([_blob_table(rows)])


def _pairs(table: pa.Table, length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a chunk: its index, and position and both hashes of neighbouring windows that both repeat."""
    kinds, blobs = table.column("kind").to_numpy(), table.column("blob")
    index = [blobs[int(i)].as_py() for i in np.flatnonzero(kinds == INDEX)]
    known = [wh.unpack(blobs[int(i)].as_py()) for i in np.flatnonzero(kinds == KNOWN)]
    if not index or not known:
        return None
    ends = np.cumsum(np.frombuffer(index[0], np.int64).reshape(-1, 5)[:, 3])
    have = np.unique(np.concatenate(known))
    at = (have >> _U(64 - POSITION_BITS)).astype(np.int64)
    hashes = have & _U((1 << (64 - POSITION_BITS)) - 1)
    nxt = np.searchsorted(at, at + length)
    ok = nxt < len(at)
    ok[ok] = at[nxt[ok]] == at[ok] + length
    i, j = np.flatnonzero(ok), nxt[ok]
    same = np.searchsorted(ends, at[i], "right") == np.searchsorted(ends, at[j], "right")
    i, j = i[same], j[same]
    return index[0], at[i], hashes[i], hashes[j]


def _doubled(length: int, bits: int):
    """Of a chunk: windows of twice the length of which both halves repeat; they are asked for again."""

    def run(table: pa.Table) -> pa.Table:
        found = _pairs(table, length)
        if found is None or not len(found[1]):
            return pa.Table.from_batches([_blob_table([])])
        index, at, left, right = found
        chunk, low = int(table.column("chunk")[0].as_py()), _U((1 << POSITION_BITS) - 1)
        hashes = wh.mix(left * _U(0xD1342543DE82EF95) + wh.mix(right))
        return pa.Table.from_batches([_blob_table([(chunk, chunk, INDEX, index), *_asked(chunk, (hashes & ~low) | at.astype(_U), bits)])])

    return run


def _candidates(length: int):
    """Of a chunk: for each text, the starts of windows of the full length of which both halves repeat."""

    def run(table: pa.Table) -> pa.Table:
        found = _pairs(table, length)
        return _spans(found[0], found[1]) if found else _spans(b"", np.zeros(0, np.int64))

    return run


def _exact(window: int, bits: int):
    """Digests of the windows at the candidate starts of whole texts, to the ranges of digests, with id and start."""

    def rows(chunk: int, pieces: list[tuple[int, int, int, int, int]], digests: list[bytes], starts: list[np.ndarray]) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(digests), ">u8").astype(_U).reshape(-1, 2)
        index, at = np.array(pieces, np.int64), np.arange(len(both))
        ids, start = np.repeat(index[:, 0], index[:, 3]), np.concatenate(starts)
        hashes, check, ids, start, at, later = _order(both[:, 0], both[:, 1], ids, start, at)
        # a piece's "words" are its candidates here: what is numbered are these, and their starts go with the index
        out = [(chunk, chunk, INDEX, index.tobytes()), (chunk, chunk, STARTS, wh.pack_any(np.concatenate(starts)))]
        if later.any():
            out.append((chunk, chunk, REMOVED, wh.pack(np.sort(at[later]).astype(_U))))
        hashes, *rest = (x[~later] for x in (hashes, check.view(np.int64), ids, start, at))
        edges = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits))
        for k, (h, *own) in enumerate(zip(*(np.split(x, edges) for x in (hashes, *rest)), strict=True)):
            if len(h):
                packed = [wh.pack(h), *(wh.pack_any(x) for x in own)]
                out.append((k, chunk, HASHES, b"".join([*(len(x).to_bytes(4, "little") for x in packed), *packed])))
        return _blob_table(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), itertools.count()
        pieces, digests, starts, n = [], [], [], 0
        for batch in batches:
            for doc, text_hash, text, packed in zip(batch.column("id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("x").cast(pa.large_binary()), batch.column("starts"), strict=True):
                own = (text.as_py() or b"").split()
                at = np.unique(np.concatenate([wh.unpack(x) for x in packed.as_py()])).astype(np.int64)
                words, ends = memoryview(b" ".join(own)), np.cumsum([len(x) + 1 for x in own])
                for k in range(0, len(at), PIECE):
                    part = at[k : k + PIECE]
                    if n + len(part) > PIECE:
                        yield rows((task << 32) | next(numbers), pieces, digests, starts)
                        pieces, digests, starts, n = [], [], [], 0
                    begin = np.where(part > 0, ends[part - 1], 0)
                    digests += [blake2b(words[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), (ends[part + window - 1] - 1).tolist(), strict=True)]
                    pieces.append((doc, text_hash, k, len(part), len(part)))
                    starts.append(part)
                    n += len(part)
        if n:
            yield rows((task << 32) | next(numbers), pieces, digests, starts)

    return run


def _order(hashes: np.ndarray, check: np.ndarray, ids: np.ndarray, start: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """All by hash, second hash, id and start, and which of them have an earlier equal: in both hashes."""
    order = np.lexsort((start, ids, check, hashes))
    hashes, check, ids, start = hashes[order], check[order], ids[order], start[order]
    head = np.ones(len(hashes), bool)
    head[1:] = (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    return hashes, check, ids, start, *(x[order] for x in more), (ids != ids[lead]) | (start != start[lead])


def _later(table: pa.Table) -> pa.Table:
    """Of a range of digests: the positions that have an earlier equal, by chunk. Other rows pass."""
    kinds, blobs, chunks = table.column("kind").to_numpy(), table.column("blob"), table.column("chunk").to_numpy()
    rows = [(int(chunks[i]), int(chunks[i]), int(kinds[i]), blobs[int(i)].as_py()) for i in np.flatnonzero(kinds != HASHES)]
    own = np.flatnonzero(kinds == HASHES)
    parts: list[list[np.ndarray]] = []
    for n, i in enumerate(own):
        blob = blobs[int(i)].as_py()
        cuts = 20 + np.cumsum([0, *np.frombuffer(blob[:20], "<u4")])
        hashes, *rest = (blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        h = wh.unpack(hashes)
        parts.append([h, *(wh.unpack_any(x) for x in rest), np.full(len(h), n)])
    if parts:
        *_, at, source, later = _order(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        at, source = at[later], source[later]
        order = np.lexsort((at, source))
        at, source = at[order], source[order]
        heads = np.flatnonzero(np.diff(source, prepend=-1))
        for x, n in zip(np.split(at, heads[1:]) if len(at) else [], source[heads].tolist(), strict=True):
            rows.append((int(chunks[own[n]]), int(chunks[own[n]]), REMOVED, wh.pack(x.astype(_U))))
    return pa.Table.from_batches([_blob_table(rows)])


_SPANS = "id long, text_hash long, starts binary"


def _spans(index: bytes, at: np.ndarray, starts: np.ndarray | None = None) -> pa.Table:
    """Of a chunk: the positions ``at`` as starts in each text; ``starts`` has them if positions number candidates."""
    out: list[tuple[int, int, bytes]] = []
    pieces = np.frombuffer(index, np.int64).reshape(-1, 5)
    if len(at):
        ends = np.cumsum(pieces[:, 3])
        piece = np.searchsorted(ends, at, "right")
        inside = at - (ends - pieces[:, 3])[piece]
        counts = inside < pieces[piece, 4]
        at, piece, inside = at[counts], piece[counts], inside[counts]
        start = inside + pieces[piece, 2] if starts is None else starts[at]
        heads = np.flatnonzero(np.diff(piece, prepend=-1))
        out = [(int(pieces[k, 0]), int(pieces[k, 1]), wh.pack(x.astype(_U))) for k, x in zip(piece[heads].tolist(), np.split(start, heads[1:]) if len(piece) else [], strict=True)]
    ids, texts, packed = zip(*out, strict=True) if out else ([],) * 3
    return pa.table({"id": pa.array(ids, pa.int64()), "text_hash": pa.array(texts, pa.int64()), "starts": pa.array(packed, pa.binary())})


def _by_text(table: pa.Table) -> pa.Table:
    """Of a chunk: the starts to be removed, for each text."""
    kinds, blobs = table.column("kind").to_numpy(), table.column("blob")
    of = lambda kind: [blobs[int(i)].as_py() for i in np.flatnonzero(kinds == kind)]
    index, gone = of(INDEX), of(REMOVED)
    if not index or not gone:
        return _spans(b"", np.zeros(0, np.int64))
    return _spans(index[0], np.unique(np.concatenate([wh.unpack(x) for x in gone])).astype(np.int64), wh.unpack_any(of(STARTS)[0]))


def _texts(documents: DataFrame, id_column: str, text_column: str) -> list[Column]:
    """id, text_hash and x of each row."""
    key, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")
    return [F.coalesce(key.cast("long"), F.lit(int(NULL_ID))).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("x")]


def repeated_starts(documents: DataFrame, window: int = 20, levels: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, starts): word positions in each text at which a window starts
    that also starts earlier, packed, in one or more rows of a text.

    ``window`` must be a multiple of 2**levels. The input must be a scan or a written
    table: a task that runs again must meet the same rows.
    """
    if levels < 1 or window % (1 << levels):
        raise ValueError("window must be a multiple of 2**levels, levels at least 1")
    small_batches(documents.sparkSession)
    size = max(1, input_bytes(documents))
    bits = int(np.clip(np.ceil(np.log2(size / 6e6)), 4, 16))
    length = window >> levels
    texts = _texts(documents, id_column, text_column)
    first = documents.select(*texts).mapInArrow(_first_level(length, window, bits), _BLOBS)
    to = F.when(F.col("kind") == HASHES, F.col("key")).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(1 << bits))).alias("to")
    known = first.groupBy(to).applyInArrow(_repeated, _BLOBS)
    for level in range(levels - 1):
        known = known.groupBy("chunk").applyInArrow(_doubled(length << level, bits), _BLOBS).groupBy(to).applyInArrow(_repeated, _BLOBS)
    found = known.groupBy("chunk").applyInArrow(_candidates(window // 2), _SPANS)
    found = written(found.groupBy("id", "text_hash").agg(F.collect_list("starts").alias("starts")), "candidates", free=True)
    # in order of id and text: a task that runs again, after a lost executor, must number the same rows alike
    joined = documents.select(*texts).join(found.hint("merge"), ["id", "text_hash"]).sortWithinPartitions("id", "text_hash").select("id", "text_hash", "x", "starts")
    late = joined.mapInArrow(_exact(window, bits), _BLOBS).groupBy(to).applyInArrow(_later, _BLOBS)
    return late.groupBy("chunk").applyInArrow(_by_text, _SPANS)


def merged_spans(starts: list[bytes], window: int) -> list[tuple[int, int]]:
    """Spans of words [from, to) that the windows at the packed ``starts`` cover."""
    at = np.unique(np.concatenate([wh.unpack(x) for x in starts])).astype(np.int64)
    cuts = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(x[0]), int(x[-1]) + window) for x in np.split(at, cuts)]


def _cut(keep_text: bool, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, out = [], [], []
            for text, starts in zip(batch.column("x").cast(pa.large_binary()), batch.column("starts"), strict=True):
                own = (text.as_py() or b"").split()
                cuts = merged_spans(starts.as_py(), window) if starts.is_valid else []
                kept, at, gone = [], 0, 0
                for a, b in cuts:
                    kept += own[at:a]
                    gone, at = gone + b - a, b
                kept = b" ".join(kept + own[at:] if cuts else own)
                n_words.append(len(own))
                n_removed.append(gone)
                out.append(kept if keep_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()) if keep_text else pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(documents: DataFrame, window: int = 20, levels: int = 1, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay, joined by a space
    (with ``digest`` their SHA-256), for every row of ``documents``.

    A null or empty text has no words; a text shorter than the window keeps all.
    Rows with the same id and text are one document: neither comes earlier than
    the other. A null id counts as the largest. Other columns play no part.
    """
    starts = repeated_starts(documents, window, levels, id_column, text_column)
    starts = written(starts.groupBy("id", "text_hash").agg(F.collect_list("starts").alias("starts")), "starts", free=True)  # a row or two for a text
    rows = documents.select(F.col(f"`{id_column}`").alias("doc_id"), *_texts(documents, id_column, text_column))
    joined = rows.join(starts.hint("shuffle_hash"), ["id", "text_hash"], "left").select("doc_id", "x", "starts")
    kind = documents.select(F.col(f"`{id_column}`")).dtypes[0][1]
    return joined.mapInArrow(_cut(not digest, window), f"doc_id {kind}, n_words long, n_removed long, kept string")
