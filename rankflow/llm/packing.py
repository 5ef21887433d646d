"""Best-fit packing of documents into sequences by linear grouping.

Only longer documents than a sequence are cut. The rest is bin packing with integer lengths up to
the sequence length, so the whole problem is a histogram of at most that many counts, whatever the
number of documents. The plan is made on it:

1. linear grouping: large pieces, over a quarter of a sequence or more, are put in order of length and cut into groups
   of equal cardinality; each length counts as the largest of its group;
2. configurations: which of these few sizes go into one sequence, and how often, from the linear program
   of the configurations (column by column), rounded down;
3. substitution: the documents of a group take its places in order, with their real lengths;
4. best fit: all others, longest first, go where the least room is left over, then into new sequences.

The plan consists of runs: pieces of one length with consecutive numbers go to consecutive sequences.
Pieces are numbered within their length by Spark, and each looks up its run.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.session import ready, released
from rankflow.llm.text_arrays import blocks
from rankflow.llm.tokens import SLICE_BYTES, default_tokenizer, encode
from rankflow.session import land

SEQUENCE = 2048
#: Numbers of groups, and parts of a sequence over which a piece is a large one. A plan is made for each
#: of their pairs, and the one with the fewest sequences is taken.
GROUPS = (8, 24)
LARGE = (1 / 4, 1 / 3, 1 / 2)

#: length, first number, end number, pieces per sequence, first sequence
Run = tuple[int, int, int, int, int]


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use each multiset of sizes; never more places than pieces of a size.

    Simplex method on the configuration program. All configurations of sizes over a quarter of the
    capacity hold three pieces at most, so that the best column is found by looking at all of them.
    """
    k = len(sizes)
    columns = []
    for n in (1, 2, 3):
        for pick in combinations_with_replacement(range(k), n):
            if sum(sizes[i] for i in pick) <= capacity:
                columns.append(pick)
    matrix = np.zeros((k, len(columns)))
    for c, pick in enumerate(columns):
        for i in pick:
            matrix[i, c] += 1
    basis = []
    for i in range(k):  # to begin with, each size by itself
        basis.append(columns.index((i,) * min(3, capacity // sizes[i])))
    demand = np.array(counts, float)
    for _ in range(200 * k):
        b = matrix[:, basis]
        x = np.linalg.solve(b, demand)
        price = np.linalg.solve(b.T, np.ones(k))
        gain = price @ matrix
        enter = int(np.argmax(gain))
        if gain[enter] <= 1 + 1e-9:
            break
        direction = np.linalg.solve(b, matrix[:, enter])
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[int(np.argmin(ratio))] = enter
    left = list(counts)
    out = []
    for c, amount in sorted(zip(basis, x.tolist(), strict=True), key=lambda p: -p[1]):
        pick = columns[c]
        need = {i: pick.count(i) for i in pick}
        n = max(0, min([int(amount + 1e-6), *(left[i] // m for i, m in need.items())]))
        if n:
            out.append((pick, n))
            for i, m in need.items():
                left[i] -= n * m
    return out


def plan_packing(
    histogram: dict[int, int], capacity: int = SEQUENCE, groups: tuple[int, ...] = GROUPS,
    large: tuple[float, ...] = LARGE,
) -> list[Run]:
    """Runs that place every piece of the histogram {length: count}, in the fewest sequences found."""
    plans = (_plan(histogram, capacity, g, share) for g in groups for share in large)
    return min(plans, key=lambda plan: plan[1])[0]


def _plan(histogram: dict[int, int], capacity: int, groups: int, share: float) -> tuple[list[Run], int]:
    """One plan and its number of sequences."""
    runs: list[Run] = []
    next_sequence = 0
    if histogram.get(capacity):
        n = histogram[capacity]
        runs.append((capacity, 0, n, 1, 0))
        next_sequence = n
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, number of them)
    large = [length for length in sorted(histogram) if capacity * share < length < capacity]
    total = sum(histogram[length] for length in large)
    if total:
        ends = np.cumsum([histogram[length] for length in large])
        cut = [total * (g + 1) // groups for g in range(groups)]
        cut = sorted({c for c in cut if c})
        sizes = [large[int(np.searchsorted(ends, c))] for c in cut]
        counts = np.diff([0, *cut]).tolist()
        taken = [0, *cut[:-1]]  # next rank to place, by group

        def place(group: int, n: int) -> list[tuple[int, int, int]]:
            """The next n pieces of a group as (length, first number, count)."""
            out, rank = [], taken[group]
            taken[group] += n
            while n:
                i = int(np.searchsorted(ends, rank, "right"))
                begin = int(ends[i]) - histogram[large[i]]
                m = min(n, int(ends[i]) - rank)
                out.append((large[i], rank - begin, m))
                rank, n = rank + m, n - m
            return out

        for pick, n in _configurations(sizes, counts, capacity):
            edges, slots = {0, n}, []
            for group in pick:
                at = 0
                for length, first, m in place(group, n):
                    runs.append((length, first, first + m, 1, next_sequence + at))
                    slots.append((at, at + m, length))
                    at += m
                    edges.add(at)
            edges = sorted(edges)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                room = capacity - sum(length for low, high, length in slots if low <= a < high)
                if room:
                    rooms.setdefault(room, []).append((next_sequence + a, b - a))
            next_sequence += n
        rest: dict[int, list[tuple[int, int]]] = {}
        for group in range(len(sizes)):
            for length, first, m in place(group, cut[group] - taken[group]):
                rest.setdefault(length, []).append((first, m))
    else:
        rest = {}
    for length, n in histogram.items():
        if n and length <= capacity * share:
            rest[length] = [(0, n)]
    order = sorted(rooms)
    for length in sorted(rest, reverse=True):
        for first, n in rest[length]:
            while n:
                i = bisect_left(order, length)
                room = order[i] if i < len(order) else capacity
                per = room // length
                if i == len(order):
                    sequence, m = next_sequence, -(-n // per)
                    next_sequence += m
                else:
                    sequence, m = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room], order[i]
                    need = -(-n // per)
                    if m > need:
                        _put(rooms, order, room, sequence + need, m - need)
                        m = need
                full, odd = divmod(min(n, m * per), per)
                if full:
                    runs.append((length, first, first + full * per, per, sequence))
                    _put(rooms, order, room - per * length, sequence, full)
                    first, n = first + full * per, n - full * per
                if odd:
                    runs.append((length, first, first + odd, odd, sequence + full))
                    _put(rooms, order, room - odd * length, sequence + full, 1)
                    first, n = first + odd, n - odd
    return runs, next_sequence


def _put(rooms: dict, order: list, room: int, sequence: int, n: int) -> None:
    if room:
        if room not in rooms:
            insort(order, room)
            rooms[room] = []
        rooms[room].append((sequence, n))


def _cut_rows(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for batch in blocks(batches, "text", SLICE_BYTES):
            ids, offsets = encode(batch.column("text"), path, end_id)
            n = np.diff(offsets)
            counts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            head = (n - 1) % capacity + 1  # the first piece is the shorter one
            length = np.where(piece == 0, head[row], capacity)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            begin = (offsets[row] + start) * 4
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [
                zlib.crc32(raw[a : a + 4 * b]) for a, b in zip(begin.tolist(), length.tolist(), strict=True)
            ]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            groups, first, size = np.unique(ordered, return_index=True, return_counts=True)
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(order)) - np.repeat(first, size) + np.repeat(seen[groups], size)
            seen[groups] += size
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "part": pa.array(np.full(len(row), part, np.int32)),
                "number": pa.array(number),
            }
            if with_ids:
                bounds = np.append(offsets[row] + start, len(ids)).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def cut_documents(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = SEQUENCE, with_ids: bool = False
) -> DataFrame:
    """Token pieces of every row of ``docs``: doc_id, piece, start, length, ids_crc32 (and ids), landed.

    A null or empty text is the end id alone. Repeated rows and rows with a null doc_id are packed like
    any other. Other columns are ignored. ``part`` and ``number`` tell pieces of one length apart.
    """
    ready(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
    schema += ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = released(_cut_rows(tokenizer or default_tokenizer(), end_id, capacity, with_ids))
    return land(rows.mapInArrow(cut, schema))


def _look_up(runs: list[Run]):
    runs = sorted(runs)
    key = np.array([(r[0] << 44) + r[1] for r in runs], np.int64)
    first, per, sequence = (np.array([r[i] for r in runs], np.int64) for i in (1, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            i = np.searchsorted(key, (length << 44) + number, "right") - 1
            found = sequence[i] + (number - first[i]) // per[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "sequence_id"])

    return run


def pack(pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``pieces`` of ``cut_documents`` with their sequence_id and offset.

    Only a histogram of lengths, at most ``capacity`` rows, comes to the driver. An empty table has
    no sequences.
    """
    # Pieces of a length before each task's own: one row per task and length.
    counts = land(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = pieces.join(counts, ["part", "length"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("_before")).drop("_before")
    columns = [c for c in numbered.columns if c != "sequence_id"]
    numbered = numbered.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    placed = numbered.mapInArrow(_look_up(plan_packing(histogram, capacity)), f"{schema}, sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "number")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0).cast("long"))
    return placed.withColumn("offset", offset).drop("part", "number")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of pieces packed with their ids: at most a sequence length of ids."""
    members = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(members.alias("m")).select(
        "sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.doc_id").alias("doc_ids")
    )
