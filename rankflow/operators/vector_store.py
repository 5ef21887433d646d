"""Vectors of texts that are kept between runs.

Encoding is the costly part of scoring. A store holds the vector of each text under the text's hash, in one
versioned table per encoder version, so that a text is encoded once by each encoder, whichever experiments, folds
and runs it is in. What is new is found by an anti join on the hashes; a finished append is a new
version, a stopped one leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.operators.embedding import BATCH_SIZE, Encoder, embed_texts, text_key
from rankflow.operators.reduction import distinct_keys, keep_keys
from rankflow.session import land
from rankflow.sinks.snapshots import VERSION, SnapshotTable, newest_rows

SCHEMA = "text_key string, embedding array<double>"


class VectorStore:
    """The vectors of one encoder; ``encoder`` names it and its version."""

    def __init__(self, spark: SparkSession, path: str, encoder: str):
        folder = hashlib.sha256(encoder.encode()).hexdigest()[:32]
        self.encoder = encoder
        self.table = SnapshotTable(spark, f"{path.rstrip('/')}/{folder}", SCHEMA)

    def embed(
        self,
        texts: DataFrame,
        column: str,
        load_encoder: Callable[[], Encoder],
        batch_size: int = BATCH_SIZE,
        ident: Sequence[str] = (),
    ) -> DataFrame:
        """``text_key, embedding`` of every distinct text of ``column``; only texts not in the store are encoded.

        The result is pinned to the version it was read from. Two runs that encode one text at the same time
        both append it; the later vector counts then. ``texts`` is read twice and should be a table.
        """
        keyed = texts.select(text_key(column).alias("text_key"), F.col(column).alias("_text"), *ident)
        wanted = distinct_keys(keyed, "text_key")
        base = self.table.version()
        missing = land(wanted.join(self.table.read(base).select("text_key"), "text_key", "left_anti"))
        if not missing.isEmpty():
            texts = keep_keys(keyed, missing, "text_key").drop("text_key")
            new = embed_texts(texts, "_text", load_encoder, batch_size, ident)
            base = self.table.append(new, {"encoder": self.encoder})
        found = keep_keys(self.table.read(base), wanted, "text_key")
        return newest_rows(found, ["text_key"]).drop(VERSION)
