"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Rows lie in ascending order of doc_id over the files, so the statistics of files, stripes and row
groups cut a range of ids to a few row groups, and the Bloom filters answer a lookup of one id.
Stripes are read in parallel; nothing in a row depends on another stripe, because each row holds its
place within its file part and the parts are put in order when they are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankflow.llm.session import ready, released
from rankflow.llm.text_arrays import blocks
from rankflow.llm.tokens import SLICE_BYTES, default_tokenizer, encode

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, part int, place long, ids array<int>"


def _encode_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        place = 0
        for batch in blocks(batches, "text", SLICE_BYTES):
            ids, offsets = encode(batch.column("text"), path, end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, part, np.int32)),
                    pa.array(offsets[:-1] + place),
                    pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32))
                    ),
                ],
                names=["doc_id", "part", "place", "ids"],
            )
            place += int(offsets[-1])

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, mode: str = "error"
) -> None:
    """Write (doc_id, part, place, ids) of every row of ``docs`` in ascending order of doc_id.

    A null or empty text has the end id alone. Rows with a null doc_id come first; rows with the same
    doc_id follow each other in order of their text. Other columns are ignored. Texts are shuffled
    once, by ranges of doc_id, and encoded behind that shuffle; ``part`` is the number of the range.
    """
    ready(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(released(_encode_rows(tokenizer or default_tokenizer(), end_id)), SCHEMA)
    coded.write.mode(mode).options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the files with ``start``, the number of ids before the row in the whole order."""
    rows = spark.read.schema(SCHEMA).orc(path)
    # One row per file part, whatever the number of rows in it.
    last = rows.groupBy("part").agg(F.max(F.col("place") + F.size("ids")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = last.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(first), "part").select(
        "doc_id", (F.col("first") + F.col("place")).alias("start"), "ids"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        raw = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
        at = np.asarray(ids.offsets).astype(np.int64)
        at = (at - at[0]) * 4
        raw = memoryview(raw).cast("B")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at) // 4), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that ``read_tokens`` returns."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return rows.select("doc_id", "start", "ids").mapInArrow(released(_digest), schema)
