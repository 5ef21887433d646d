"""Differences of tables by row fingerprints.

A row's fingerprint is the MD5 of its values written out unambiguously. Only fingerprints and counts are shuffled;
whole rows are fetched for the fingerprints that occur once. Columns of any type but variants can be
compared, maps included, which a grouping by the row refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.operators.reduction import keep_distinct_keys
from rankflow.session import land

_ATOMS = (
    T.StringType, T.BooleanType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampNTZType,
    T.DayTimeIntervalType, T.YearMonthIntervalType, T.NullType,
)


def written(value: Column, kind: T.DataType) -> Column:
    """A value as text that no other value of its type has: bytes' count, colon, text; a null is a hyphen.

    As in a grouping, zero and minus zero are one value, and so are all NaNs; the order of a map's entries
    doesn't count.
    """
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.when(value == 0, F.lit("0.0")).otherwise(value.cast("string"))
    elif isinstance(kind, T.BinaryType):
        text = F.hex(value)
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(value).cast("string")
    elif isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(value, lambda x: written(x, kind.elementType)), "")
    elif isinstance(kind, T.StructType):
        parts = [written(value.getField(f.name), f.dataType) for f in kind]
        text = F.when(value.isNotNull(), F.concat(F.lit(""), *parts))
    elif isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.concat(written(e["key"], kind.keyType), written(e["value"], kind.valueType)),
        )
        text = F.array_join(F.array_sort(entries), "")
    elif isinstance(kind, _ATOMS):
        text = value.cast("string")
    else:
        raise TypeError(f"rows with a column of type {kind.simpleString()} can't be compared")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_text(rows: DataFrame) -> Column:
    """All values of a row, written out."""
    return F.concat(F.lit(""), *[written(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema])


def fingerprint(text: Column) -> Column:
    return F.unhex(F.md5(text))


def table_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur once in both tables together; a row twice in one table drops out too.

    Columns go by position and take the names of ``left``. A fingerprint that rows of another hash share as well
    is no proof that they are equal; such rows are compared by their whole text.
    """
    rows = left.unionAll(right)
    marked = rows.withColumn("_print", fingerprint(row_text(rows)))
    prints = marked.select("_print", F.xxhash64(row_text(rows)).alias("_check"))
    counted = prints.groupBy("_print").agg(
        F.count(F.lit(1)).alias("_copies"), (F.min("_check") != F.max("_check")).alias("_unlike")
    )
    found = land(counted.where("_copies = 1 or _unlike"))
    once = keep_distinct_keys(marked, found.where("not _unlike").select("_print"), "_print").drop("_print")
    unlike = found.where("_unlike").select("_print")
    if unlike.isEmpty():
        return once
    shared = keep_distinct_keys(marked, unlike, "_print").drop("_print").withColumn("_text", row_text(rows))
    single = land(shared.groupBy("_text").agg(F.count(F.lit(1)).alias("_copies")).where("_copies = 1").drop("_copies"))
    return once.unionByName(shared.join(single, "_text", "left_semi").drop("_text"))
