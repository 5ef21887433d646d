"""Mean pooling: the mean of the vectors of a text's tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.operators.batches import known_postings, posting_slices, whole_documents
from rankflow.operators.retrieval import unique_documents
from rankflow.session import land

# Numbers in a token-vector table that goes to every task, where 8 bytes of tokens count as a number: 64 MB.
BROADCAST_VALUES = 8_000_000
# What a worker holds of a token beside its bytes and its vector: offsets and a place in the lookup table.
_TOKEN_BYTES = 64
# Numbers that are summed and postings that are looked up at a time.
_CHUNK_VALUES = 2_000_000
_CHUNK_POSTINGS = 250_000
# Vectors up to this length are summed a column for each number.
_COLUMNS = 32


def _pool_documents(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        dim = table["vectors"].shape[1]
        for whole in batches:
            for batch in posting_slices(whole, _CHUNK_POSTINGS):
                doc, term, tf = known_postings(batch.column("terms"), table["tokens"])
                for c in whole_documents(np.full(len(doc), dim), doc, _CHUNK_VALUES):
                    first = np.flatnonzero(np.r_[True, doc[c][1:] != doc[c][:-1]])
                    total = np.add.reduceat(table["vectors"][term[c]] * tf[c][:, None], first)
                    mean = total / np.add.reduceat(tf[c], first)[:, None]
                    ids = batch.column("doc_id").take(pa.array(doc[c][first]))
                    offsets = pa.array(np.arange(len(first) + 1, dtype=np.int32) * dim)
                    vectors = pa.ListArray.from_arrays(offsets, pa.array(mean.ravel()))
                    yield pa.RecordBatch.from_arrays([ids, vectors], ["doc_id", "mean_vector"])
            pa.default_memory_pool().release_unused()

    return run


def _one_vector_per_token(token_vectors: DataFrame) -> DataFrame:
    vector = F.col("vector").cast("array<double>")
    known = token_vectors.select("token", vector.alias("vector")).where(
        F.col("token").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    )
    counts = land(known.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token"))
    if counts.isEmpty():
        return known
    several = known.join(counts, "token", "left_semi").groupBy("token")
    mean = several.agg(vector_to_array(Summarizer.mean(array_to_vector("vector"))).alias("vector"))
    return known.join(counts, "token", "left_anti").unionByName(mean)


def mean_pool(
    index: DataFrame, token_vectors: DataFrame, broadcast_values: int = BROADCAST_VALUES
) -> DataFrame:
    """``doc_id, mean_vector`` for every document with a known token; others do not count.

    ``index`` is that of ``retrieval.doc_vectors``; ``token_vectors`` has ``token, vector``. A token
    whose vector is null or holds a null is unknown; a token with several vectors has their mean;
    vectors of unequal length are an error. Rows of the index with the same id are one document.

    A vocabulary below the bound, tokens and vectors together, goes to every task, which pools whole documents
    without a shuffle. Beyond it, tokens and vectors are joined on the token, where AQE splits a frequent token, and
    the sums are combined per document, without Python. Both ways give the same rows.
    """
    table = land(_one_vector_per_token(token_vectors))
    size = table.agg(
        F.max(F.size("vector")).alias("dim"),
        F.min(F.size("vector")).alias("least"),
        F.sum(F.octet_length("token") + F.lit(_TOKEN_BYTES) + 8 * F.size("vector")).alias("bytes"),
    ).first()
    if size["dim"] != size["least"]:
        raise ValueError(f"token vectors of {size['least']} to {size['dim']} numbers")
    documents = unique_documents(index).select("doc_id", "terms")
    dim = size["dim"] or 0  # none without a vector
    if dim and size["bytes"] <= 8 * broadcast_values:
        rows = table.toArrow().combine_chunks()
        values = pc.list_flatten(rows["vector"].combine_chunks()).to_numpy(zero_copy_only=False)
        shared = index.sparkSession.sparkContext.broadcast(
            {
                "tokens": rows["token"].combine_chunks(),
                "vectors": values.reshape(-1, dim),
            }
        )
        doc_id = index.schema["doc_id"].dataType.simpleString()
        pooled = f"doc_id {doc_id}, mean_vector array<double>"
        return documents.mapInArrow(_pool_documents(shared), pooled)
    terms = documents.select("doc_id", F.explode("terms").alias("t"))
    terms = terms.select("doc_id", F.col("t.term").alias("token"), F.col("t.tf").alias("tf"))
    found = terms.join(table, "token")
    if 0 < dim <= _COLUMNS:
        sums = [F.sum(F.col("tf") * F.get("vector", F.lit(i))).alias(f"_{i}") for i in range(dim)]
        total = found.groupBy("doc_id").agg(F.sum("tf").alias("_tf"), *sums)
        mean = F.array(*[F.col(f"_{i}") / F.col("_tf") for i in range(dim)])
        return total.select("doc_id", mean.alias("mean_vector"))
    mean = Summarizer.mean(array_to_vector("vector"), F.col("tf").cast("double"))
    return found.groupBy("doc_id").agg(vector_to_array(mean).alias("mean_vector"))
