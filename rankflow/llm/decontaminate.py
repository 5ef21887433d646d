"""Benchmark decontamination with spaced seeds.

A seed is a mask of word positions, of which some are ignored: ``111101`` hashes five of six words, so
that a replaced word at the fifth place doesn't hide a match. All masked windows of the benchmark are
indexed; every whole document is scanned with the same masks. Each hit fixes an alignment of the
document with an item, and the words around it are compared one by one: the pair is reported if some
stretch of ``window`` aligned words (the whole item if it is shorter) agrees in ``similarity`` of
them at least. Insertions and deletions end an alignment, and the words behind them form another.

The masks find every stretch of 13 words with up to two replaced. Shorter items have further masks, with
which a fifth of their words may be replaced; items of fewer than five words are found as exact copies
(a test tries all patterns of all lengths). Hits are looked at a bounded number at a time, each with the
few words that share a stretch with it, and only those that would begin before the alignment already known
for their pair; so a text that repeats itself costs neither memory nor the square of its length.

The benchmark is indexed in blocks of bounded size, each broadcast to a scan of the documents, one after
the other; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm.session import ready, released
from rankflow.llm.text_arrays import Words, constants, slices, words
from rankflow.session import land

MASKS = ("11111", "111101", "101111", "1101101")
#: Further masks where 5 to 12 words are compared, and those where fewer are: the whole item.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
WHOLE_MASKS = ("1", "11", "111", "1111")
_FILTER_BITS = 22
#: Characters of benchmark text indexed at once: the index takes about 20 bytes for each.
BLOCK_CHARS = 8_000_000
#: Hits compared at a time, each with up to twice a window of words.
_HITS = 1 << 14


class Seeds(NamedTuple):
    """The word positions of one mask in order of seed and item; group i has ``places[first[i]:first[i] + n[i]]``."""

    value: np.ndarray
    item: np.ndarray
    first: np.ndarray
    n: np.ndarray
    places: np.ndarray


@dataclass
class SeedIndex:
    """Benchmark words, and all their seeds."""

    items: list
    hashes: np.ndarray
    offsets: np.ndarray
    seeds: list[Seeds]
    filters: list[np.ndarray]
    window: int
    similarity: float
    masks: tuple[str, ...]


def _seeds(found: Words, mask: str, key: int) -> np.ndarray:
    """The seed at every word position, including windows that reach into the next row."""
    n = len(found.hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for j, (used, factor) in enumerate(zip(mask, constants(len(mask), key), strict=True)):
        if used == "1":
            value += found.hashes[j : j + n] * factor
    return value


def _inside(found: Words, at: np.ndarray, span: int) -> np.ndarray:
    """Those positions whose windows of ``span`` words stay within their row."""
    row = np.searchsorted(found.offsets, at, "right") - 1
    return at + span <= found.offsets[row + 1]


def masks_for(n_words: int, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """The masks of an item of which ``n_words`` words are compared."""
    if n_words < 5:
        return WHOLE_MASKS[n_words - 1 : n_words] if n_words else ()
    return (*masks, *SHORT_MASKS) if n_words < 13 else masks


def build_index(items: list, texts: list, window: int, similarity: float, masks: tuple[str, ...]) -> SeedIndex:
    found = words(pa.array(texts, pa.string()))
    compared = np.minimum(np.diff(found.offsets), window)
    users: dict[str, list[int]] = {}
    for n in np.unique(compared).tolist():
        for mask in masks_for(n, masks):
            users.setdefault(mask, []).append(n)
    masks = tuple(users)
    seeds, filters = [], []
    for key, mask in enumerate(masks):
        value = _seeds(found, mask, 10 + key)
        at = np.arange(len(value))
        at = at[_inside(found, at, len(mask))]
        at = at[np.isin(compared[np.searchsorted(found.offsets, at, "right") - 1], users[mask])]
        at = at[np.argsort(value[at], kind="stable")]
        there = np.zeros(1 << _FILTER_BITS, bool)
        there[value[at] >> np.uint64(64 - _FILTER_BITS)] = True
        item = np.searchsorted(found.offsets, at, "right") - 1
        head = np.ones(len(at), bool)
        head[1:] = (value[at[1:]] != value[at[:-1]]) | (item[1:] != item[:-1])
        first = np.flatnonzero(head)
        seeds.append(Seeds(value[at[first]], item[first], first, np.diff(first, append=len(at)), at))
        filters.append(there)
    return SeedIndex(items, found.hashes, found.offsets, seeds, filters, window, similarity, masks)


def _ranges(n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place within it) for rows of ``n`` places each, ``most`` places at a time."""
    ends = np.cumsum(n)
    for low in range(0, int(ends[-1]) if len(ends) else 0, most):
        flat = np.arange(low, min(low + most, int(ends[-1])))
        row = np.searchsorted(ends, flat, "right")
        yield row, flat - (ends[row] - n[row])


def _hits(found: Words, index: SeedIndex, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word position, group of the index) wherever a seed of one mask meets, a bounded number at a time."""
    mask, seeds = index.masks[key], index.seeds[key]
    value = _seeds(found, mask, 10 + key)
    at = np.flatnonzero(index.filters[key][value >> np.uint64(64 - _FILTER_BITS)])
    at = at[_inside(found, at, len(mask))]
    low = np.searchsorted(seeds.value, value[at], "left")
    high = np.searchsorted(seeds.value, value[at], "right")
    for row, place in _ranges(high - low, _HITS):
        yield at[row], low[row] + place


def _agree(found: Words, index: SeedIndex, row, item, at, place, span: int) -> np.ndarray:
    """Whether a stretch that holds the ``span`` words of the hit agrees, for each hit."""
    length = np.diff(index.offsets)[item]
    out = np.zeros(len(at), bool)
    for size in np.unique(np.minimum(length, index.window)).tolist():
        pick = np.flatnonzero(np.minimum(length, index.window) == size)
        reach = max(0, size - span)
        around = np.arange(-reach, size)
        mine, theirs = at[pick, None] + around, place[pick, None] + around
        low, high = found.offsets[row[pick], None], found.offsets[row[pick] + 1, None]
        first, last = index.offsets[item[pick], None], index.offsets[item[pick] + 1, None]
        there = (mine >= low) & (mine < high) & (theirs >= first) & (theirs < last)
        same = found.hashes[np.where(there, mine, 0)] == index.hashes[np.where(there, theirs, 0)]
        total = np.zeros((len(pick), len(around) + 1), np.int64)
        np.cumsum(same & there, axis=1, out=total[:, 1:])
        begin = place[pick, None] + around[: reach + 1]
        fits = (begin >= first) & (begin + size <= last)
        most = np.where(fits, total[:, size:] - total[:, : reach + 1], 0).max(axis=1)
        out[pick] = most >= index.similarity * size - 1e-9
    return out


class _Earliest:
    """For each pair of a row and an item, the least word position at which an agreeing alignment begins."""

    def __init__(self) -> None:
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def before(self, pair: np.ndarray, start: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.ones(len(pair), bool)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return (self.pairs[at] != pair) | (start < self.starts[at])

    def add(self, pair: np.ndarray, start: np.ndarray) -> None:
        pair, start = np.concatenate([self.pairs, pair]), np.concatenate([self.starts, start])
        order = np.lexsort((start, pair))
        self.pairs, first = np.unique(pair[order], return_index=True)
        self.starts = start[order][first]


def overlaps(found: Words, index: SeedIndex) -> list[tuple[int, int, int, int, int]]:
    """(row, item row, first word in the row, equal words, words of the item) of each pair that agrees.

    Of several agreeing alignments of a pair it is the one that begins first.
    """
    earliest, n_items = _Earliest(), len(index.offsets) - 1
    for key, mask in enumerate(index.masks):
        seeds = index.seeds[key]
        # The item's first word falls on ``at`` less the place of the hit in the item: least for the last place.
        last = seeds.places[seeds.first + seeds.n - 1] - index.offsets[seeds.item]
        for at, group in _hits(found, index, key):
            row = np.searchsorted(found.offsets, at, "right") - 1
            pair = row * n_items + seeds.item[group]
            while len(at):
                open_ = earliest.before(pair, at - last[group])
                at, group, row, pair = at[open_], group[open_], row[open_], pair[open_]
                taken = max(1, int(np.searchsorted(np.cumsum(seeds.n[group]), _HITS, "right")))
                for hit, nth in _ranges(seeds.n[group[:taken]], _HITS):
                    place = seeds.places[seeds.first[group[hit]] + nth]
                    item = seeds.item[group[hit]]
                    start = at[hit] - (place - index.offsets[item])
                    new = np.flatnonzero(earliest.before(pair[hit], start))
                    hit, place, item, start = hit[new], place[new], item[new], start[new]
                    good = _agree(found, index, row[hit], item, at[hit], place, len(mask))
                    if good.any():
                        earliest.add(pair[hit][good], start[good])
                at, group, row, pair = at[taken:], group[taken:], row[taken:], pair[taken:]
    out = []
    for pair, start in zip(earliest.pairs.tolist(), earliest.starts.tolist(), strict=True):
        row, item = divmod(pair, n_items)
        theirs = index.hashes[index.offsets[item] : index.offsets[item + 1]]
        low, high = int(found.offsets[row]), int(found.offsets[row + 1])
        a, b = max(start, low), min(start + len(theirs), high)
        equal = int((found.hashes[a:b] == theirs[a - start : b - start]).sum())
        out.append((row, item, a - low, equal, len(theirs)))
    return out


def _report(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hits = overlaps(words(batch.column("text")), index.value)
                rows = pa.array([h[0] for h in hits], pa.int64())
                items = [index.value.items[h[1]] for h in hits]
                numbers = [pa.array([h[i] for h in hits], pa.int64()) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), pa.array(items, pa.int64()), *numbers],
                    names=["doc_id", "item_id", "first_word", "n_equal", "n_item_words"],
                )

    return run


def _without(index: Broadcast, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hit = np.zeros(batch.num_rows, bool)
                found = overlaps(words(batch.column("text")), index.value)
                hit[[h[0] for h in found if h[4] >= least_words]] = True
                yield batch.filter(pa.array(~hit))

    return run


def _indexes(benchmark: DataFrame, window: int, similarity: float, masks: tuple[str, ...], block_chars: int):
    """(broadcast index, whether it is the only one) over blocks of the benchmark of about ``block_chars`` characters."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.where("item_id is not null and length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // block_chars) or 1
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        part.sort(key=lambda r: (r["item_id"], r["text"]))
        index = build_index([r["item_id"] for r in part], [r["text"] for r in part], window, similarity, masks)
        yield spark.sparkContext.broadcast(index), n_blocks == 1


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8,
    masks: tuple[str, ...] = MASKS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, first_word, n_equal, n_item_words) for each document that holds part of an item.

    ``first_word`` is the word of the document where the aligned item begins (0 if it begins before),
    ``n_equal`` how many of the item's ``n_item_words`` words agree there; of several alignments that agree the
    first is reported.

    Null and empty texts hold nothing. Items with a null id or text are left out; items of fewer than
    five words are found as exact copies only. Repeated rows of either table are reported once each. Rows with a null
    doc_id are reported under null. Other columns are ignored. A benchmark of more than one block is met block by
    block: each one's report is landed before the next is indexed.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, n_equal long, n_item_words long"
    found = None
    for index, only in _indexes(benchmark, window, similarity, masks, block_chars):
        part = docs.mapInArrow(released(_report(index)), schema)
        if not only:
            part = land(part)
            index.destroy()
        found = part if found is None else found.union(part)
    return found


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8,
    masks: tuple[str, ...] = MASKS, block_chars: int = BLOCK_CHARS, least_words: int = 5,
) -> DataFrame:
    """``docs``, all columns, without the rows that hold part of an item of ``least_words`` words or more.

    Shorter items (a word such as "the") say nothing about where a document comes from: ``contaminated`` reports
    them, but nothing is removed for them. Null and empty texts stay. Nothing is shuffled; with more than one block
    the rows kept are landed after each.
    """
    ready(docs.sparkSession)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    for index, only in _indexes(benchmark, window, similarity, masks, block_chars):
        docs = docs.mapInArrow(released(_without(index, least_words)), schema)
        if not only:
            docs = land(docs)
            index.destroy()
    return docs
