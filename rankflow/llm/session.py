"""What the operators of this subpackage ask of a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from rankflow.session import ship

#: Rows of a batch between the JVM and a Python worker; texts are long, and both sides hold batches.
BATCH_ROWS = 1000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Send the code to the workers, and lower the session's rows per batch to ``BATCH_ROWS``."""
    ship(spark)
    if not 0 < int(spark.conf.get(_SETTING, "10000")) <= BATCH_ROWS:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow; a worker gives memory back after each batch, and holds none while it waits for a task."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return lean
