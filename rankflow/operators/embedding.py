"""Vectors of the distinct texts of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.operators.reduction import keep_keys
from rankflow.session import land

if TYPE_CHECKING:
    from rankflow.operators.vector_store import VectorStore

# Rows per call of the encoder.
BATCH_SIZE = 10_000

Encoder = Callable[[np.ndarray], np.ndarray]


def text_key(column: str) -> Column:
    """A short key for joining vectors back to texts without shuffling the texts again."""
    return F.sha2(column, 256)


def embed_texts(
    texts: DataFrame,
    column: str,
    load_encoder: Callable[[], Encoder],
    batch_size: int = BATCH_SIZE,
    ident: Sequence[str] = (),
) -> DataFrame:
    """``text_key, embedding`` for every distinct text of ``column``.

    ``load_encoder`` runs once per Python worker and returns a function from an array of texts to
    a matrix of vectors. Keys are made distinct first, so that a text that stands on many rows is
    fetched from few of them and not moved with all: from those that agree in the columns ``ident``, in
    all columns by default. ``texts`` is read twice and should be a table.
    """
    encode = predict_batch_udf(
        load_encoder, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    keyed = texts.select(
        text_key(column).alias("text_key"), F.col(column).alias("_text"), F.xxhash64(*(ident or texts.columns)).alias("_id")
    ).where("_text is not null")
    first = keyed.groupBy("text_key").agg(F.min("_id").alias("_id"))
    distinct = keep_keys(keyed, first, "_id").dropDuplicates(["text_key"])
    return distinct.select("text_key", encode("_text").alias("embedding"))


def embed_sides(
    candidates: DataFrame,
    load_encoder: Callable[[], Encoder],
    batch_size: int = BATCH_SIZE,
    store: VectorStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The vectors of all queries and passages, landed; those that ``store`` has are not made again."""
    embed = embed_texts if store is None else store.embed
    ident = [c for c in ("query_id", "dbpedia_entity") if c in candidates.columns]
    queries, passages = (embed(candidates, c, load_encoder, batch_size, ident) for c in ("query_text", "abstract"))
    return land(queries), land(passages)


def attach_embedding(rows: DataFrame, embedded: DataFrame, key: str, name: str) -> DataFrame:
    """Vectors joined on the short key of a text; the text itself is not shuffled."""
    vectors = embedded.select(F.col("text_key").alias(key), F.col("embedding").alias(name))
    return rows.join(vectors, key, "left")
