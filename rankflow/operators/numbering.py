"""Row numbers without a global window: no task ever holds all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.session import land

# monotonically_increasing_id() is (partition << 33) + position within the partition.
_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def _offsets(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows before each run; ``counts`` holds one row per partition or file split."""
    before = Window.orderBy(*order)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def dense_ordinal(
    df: DataFrame, order: Sequence[str | Column], name: str = "ordinal"
) -> DataFrame:
    """Number the rows 0..n-1 in the given order.

    One range-partitioned sort, landed so that the partitions are the same for the second pass;
    then each partition adds the row count of the partitions before it. Rows that tie on
    ``order`` are split over partitions by a hash of the whole row.
    """
    tie = F.xxhash64(*df.columns)
    placed = land(
        df.orderBy(*order, tie).withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _POSITION_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # Bounded: one row per sorted partition.
    offsets = F.broadcast(_offsets(counts, ["_part"]).select("_part", "_offset"))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND(F.lit(_POSITION_MASK)))
        .drop("_part", "_offset", "_place")
    )


def rank_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """Rank 1..n within each group; a hot group is sorted by many tasks, not by one."""
    numbered = dense_ordinal(df, [*group, *order], "_ordinal")
    first = numbered.groupBy(*group).agg(F.min("_ordinal").alias("_first"))
    return (
        numbered.join(land(first), list(group))
        .withColumn(name, F.col("_ordinal") - F.col("_first") + 1)
        .drop("_ordinal", "_first")
    )


def number_lines(lines: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number the lines of a text scan in file order (by path, then by position).

    Within a split lines keep their order, so the line number is the count of lines in the splits
    before plus the position in the split. The lines are landed with split and position, because
    a second scan may cut the file elsewhere. ``lines`` must be a text scan with at most filters
    on top of it.
    """
    placed = land(
        lines.select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_place"),
        )
    )
    counts = placed.groupBy("_path", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    # Bounded: one row per file split, about 100 bytes for up to 128 MB of text.
    offsets = F.broadcast(_offsets(counts, ["_path", "_start"]).drop("_rows"))
    return (
        placed.join(offsets, ["_path", "_start"])
        .withColumn(name, F.col("_offset") + F.col("_place") - F.col("_first"))
        .drop("_path", "_start", "_place", "_first", "_offset")
    )


def running_total(
    df: DataFrame, ordinal: str, value: str, name: str, block: int = 65536
) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ordinal.

    Windows cover one block of ordinals at a time; blocks are linked by their totals. The block
    totals are one row per ``block`` rows, so the single window over them stays small.
    """
    blocked = df.withColumn("_block", F.floor(F.col(ordinal) / block))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_rows"))
    links = _offsets(totals, ["_block"]).select("_block", "_offset")
    inside = Window.partitionBy("_block").orderBy(ordinal)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.join(links, "_block")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_offset")
    )


def running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, str]
) -> DataFrame:
    """Sums within each group up to and including a row, in the given order; a hot group is many tasks' work.

    ``sums`` maps each new column to the column it adds up. One range-partitioned sort, landed; a window never
    leaves a sorted partition, and partitions of one group are linked by their totals, of which there are
    as many as partitions that hold the group. Sums start anew in each group, so that a group's sums don't
    lose digits to those of others. Rows that tie come in any order. Groups must not be null.
    """
    tie = F.monotonically_increasing_id()  # rows of one group and one place are parted too
    placed = land(
        df.withColumn("_tie", tie)
        .orderBy(*group, *order, "_tie")
        .drop("_tie")
        .withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", _POSITION_BITS))
    names = {name: f"_before_{i}" for i, name in enumerate(sums)}
    totals = placed.groupBy("_part", *group).agg(*[F.sum(c).alias(names[n]) for n, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = land(totals.withColumns({b: F.coalesce(F.sum(b).over(earlier), F.lit(0)) for b in names.values()}))
    inside = Window.partitionBy("_part", *group).orderBy("_place")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    linked = summed.join(before, ["_part", *group])
    return linked.withColumns({n: F.col(n) + F.col(b) for n, b in names.items()}).drop(
        "_part", "_place", *names.values()
    )
