"""Vectorised word and n-gram hashing over Arrow string columns.

A batch of texts is one byte buffer with offsets. Words are found with table
look-ups on bytes, and a word's hash is a difference of prefix sums of a
polynomial modulo 2**64, so no Python object is made for a word. Memory is
bounded by ``SEGMENT`` bytes of text at a time, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(n, _U), np.ones(n, _U)
    up[1:], down[1:] = _U(base), _U(inverse)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(SEGMENT, 1 << int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    letters, is_word = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if kind == "space":  # words are runs of anything but ASCII white space
        is_word[[0x20, *range(0x09, 0x0E)]] = False
    else:  # "alnum": ASCII letters, in lower case, digits, and all beyond ASCII
        is_word[:0x80] = False
        is_word[0x30:0x3A] = is_word[0x41:0x5B] = is_word[0x61:0x7B] = True
        letters[0x41:0x5B] += 0x20
    return letters, is_word


TABLES = {kind: _tables(kind) for kind in ("space", "alnum")}


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _segment(data: np.ndarray, cuts: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``; no word goes across ``cuts``."""
    letters, is_word = TABLES[kind]
    inside = is_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = cuts[(cuts >= 0) & (cuts < len(data))]
    before[0] = after[-1] = False
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((letters[data].astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def words(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, starts, ends, hashes) of the texts in ``data[offsets[i]:offsets[i + 1]]``.

    Starts and ends are byte positions in ``data``. Works through segments of
    about ``SEGMENT`` bytes that end between words.
    """
    is_word = TABLES[kind][1]
    at, stop = int(offsets[0]), int(offsets[-1])
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while at < stop:
        end = min(at + SEGMENT, stop)
        while end < stop:  # back to a byte between words, or on to one
            gap = np.flatnonzero(~is_word[data[max(at, end - 4096) : end]])
            if len(gap):
                end = max(at, end - 4096) + int(gap[-1]) + 1
                break
            end = min(end + 4096, stop)
        starts, ends, hashes = _segment(data[at:end], offsets - at, kind)
        parts.append((starts + at, ends + at, hashes))
        at = end
    starts, ends, hashes = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else [()] * 3, (np.int64, np.int64, _U), strict=True))
    return np.searchsorted(starts, offsets), starts, ends, hashes


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``SEGMENT`` bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        yield i, j
        i = j


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` consecutive entries, across texts too."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = powers(_WORD_BASE, len(hashes))
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * down[:n])


def pack(values: np.ndarray) -> bytes:
    """Sorted uint64 values as compressed differences."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=_U(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, _U)
    n = int.from_bytes(blob[-8:], "little")
    planes = np.frombuffer(pa.decompress(blob[:-8], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


def pack_any(values: np.ndarray) -> bytes:
    """Any int64 values, compressed by byte planes."""
    values = np.ascontiguousarray(values, np.int64)
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) + len(values).to_bytes(8, "little")


def unpack_any(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[-8:], "little")
    planes = np.frombuffer(pa.decompress(blob[:-8], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()
