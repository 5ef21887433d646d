"""Words and shingles of whole Arrow text columns as numpy arrays, without a Python loop per word.

A word is a run of ASCII letters and digits and of any characters beyond ASCII, in lower case.
All functions take whole texts; a null is an empty text. Work arrays stay small because the bytes
are cut into blocks between words, wherever documents begin and end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Words(NamedTuple):
    """Hashes of all words, row after row; row i has ``hashes[offsets[i]:offsets[i + 1]]``."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64), in place."""
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    values = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed * 7919 + 1)
    return mix(values) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(n, _BASE, np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    step[0] = back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [_powers(max(n, _BLOCK * 2))]
    return _POWERS[0]


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the row offsets; a null is empty."""
    array = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of bytes that end between words."""
    at, n = 0, len(is_word)
    while at < n:
        to = min(at + _BLOCK, n)
        while to < n and is_word[to - 1] and is_word[to]:
            more = np.flatnonzero(~is_word[to : to + _BLOCK])
            to = to + int(more[0]) if len(more) else min(to + _BLOCK, n)
        yield at, to
        at = to


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Hash every word of every row."""
    if lower:
        texts = pc.utf8_lower(texts)
    data, rows = flat_bytes(texts)
    is_word = _WORD[data]
    heads = np.zeros(len(data) + 1, bool)  # rows touch in the byte array
    heads[rows] = True
    found = []
    for at, to in _cuts(is_word):
        w = is_word[at:to]
        first = w.copy()
        first[1:] &= ~w[:-1] | heads[at + 1 : to]
        last = w.copy()
        last[:-1] &= ~w[1:] | heads[at + 1 : to]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            continue
        step, back = _powers_for(to - at + 1)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum((data[at:to] + np.uint64(1)) * step[: to - at], out=total[1:])
        found.append((mix((total[e] - total[s]) * back[s]), s + at, e + at))
    if not found:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(rows), np.int64), none, none, data)
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return Words(hashes, np.searchsorted(starts, rows), starts, ends, data)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and row offsets; a shorter row is one shingle."""
    h, offsets = found.hashes, found.offsets
    n_words = np.diff(offsets)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    # Word position of every shingle: its row's first word plus its place in the row.
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    keys = constants(size, 1)
    value = np.zeros(len(at), np.uint64)
    short = np.repeat(np.minimum(n_words, size), counts)
    whole = bool(len(short) == 0 or short.min() >= size)
    for j in range(size):
        if whole:
            value += mix(h[at + j] + keys[j])
        else:
            there = short > j
            value[there] += mix(h[at[there] + j] + keys[j])
    return mix(value), out


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``max_bytes`` of text; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, put together to runs of about ``max_bytes`` of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= max_bytes:
            yield from _joined(held, column, max_bytes)
            held, size = [], 0
    if held:
        yield from _joined(held, column, max_bytes)


def _joined(held: list[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
        yield from slices(batch, column, 2 * max_bytes)
