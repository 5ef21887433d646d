"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one row (with a count) from the start. Each table hashes a vector to the signs of
``bits`` projections; vectors that share a bucket are compared exactly, in double precision. The number
of bits grows with the logarithm of the number of vectors, so that buckets stay small, and the number
of tables follows from the bits, so that a pair at the threshold is met with probability ``recall``.

A large bucket is dealt into blocks, and each pair of blocks is one task of bounded memory. A pair is
counted in the first table in which it meets, so that pairs never have to be made distinct; a task
returns link counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.components import components
from rankflow.llm.jaccard_join import spanning_forest
from rankflow.llm.session import ready
from rankflow.llm.text_arrays import constants, mix
from rankflow.session import land

THRESHOLD = 0.95
BLOCK = 512


def table_sizes(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n vectors: about 64 unrelated vectors in a bucket."""
    bits = max(6, math.ceil(math.log2(max(n, 1) / 64 + 1)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def bucket_keys(bits: int, tables: int, seed: int = 11):
    """A mapInArrow function that adds one bucket key per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("v")
            dims = np.diff(np.asarray(vectors.offsets))
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(dims) - dims
            keys = np.zeros((batch.num_rows, tables), np.uint64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, dim)).normal(size=(dim, tables * bits))
                x = flat[at[own][:, None] + np.arange(dim)]
                signs = (x @ planes[dim] > 0).reshape(len(own), tables, bits)
                value = np.full((len(own), tables), dim, np.uint64)
                for b, key in enumerate(constants(bits, 12)):
                    value += signs[:, :, b] * key
                keys[own] = mix(value + constants(tables, 13)[None, :])
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * tables
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
            columns = [batch.column(c) for c in ("rep", "copies", "v")]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["rep", "copies", "v", "keys"])

    return run


def compare_buckets(threshold: float):
    """An applyInPandas function over one pair of blocks of one bucket.

    A row (rep, null, n) adds n links to rep; a row (rep, other, null) links two representatives.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, b1, b2 = (int(pdf[c].iloc[0]) for c in ("key", "b1", "b2"))
        pdf = pdf.sort_values("rep")
        x = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
        keys = np.stack([np.asarray(k) for k in pdf["keys"]])
        reps, copies, block = (pdf[c].to_numpy() for c in ("rep", "copies", "block"))
        x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        cosine = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :])
        u, v = np.nonzero(cosine >= threshold)
        u, v = left[u], right[v]
        keep = u < v if b1 == b2 else np.ones(len(u), bool)
        u, v = u[keep], v[keep]
        first = np.argmax(keys[u] == keys[v], axis=1)
        here = keys[u, first] == key if len(u) else np.zeros(0, bool)
        u, v = u[here], v[here]
        counts = np.zeros(len(reps), np.int64)
        np.add.at(counts, u, copies[v])
        np.add.at(counts, v, copies[u])
        links = spanning_forest(u, v, len(reps))
        hit = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "rep": np.concatenate([reps[hit], reps[[i for i, _ in links]]]).astype("int64"),
                "other": pd.array([None] * len(hit) + [int(reps[j]) for _, j in links], "Int64"),
                "n": pd.array(counts[hit].tolist() + [None] * len(links), "Int64"),
            }
        )

    return run


def embedding_classes(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = 0.995, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty or zero or hold a null or non-finite component link with nothing and are
    their own component. Vectors of different length never link. A repeated row is a copy: it counts
    as a link; unlike rows of one vec_id are vectors like others. Rows with a null vec_id are not compared: component null, no links, not kept. Other
    columns are ignored.
    """
    ready(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    good = F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))
    # The groups of equal vectors, by two hashes of their components.
    rows = rows.select("vec_id", F.when(good, F.col("v")).alias("v"))
    v = F.transform("v", lambda x: x + F.lit(0.0))  # no negative zero
    hashes = [F.when(F.col("v").isNotNull(), h) for h in (F.xxhash64(v), F.xxhash64(F.lit(7), v))]
    rows = land(rows.select("vec_id", "v", hashes[0].alias("h1"), hashes[1].alias("h2")))
    texts = rows.where("v is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")
    )
    # A vector is known by a number of its own: unlike vectors may share an id.
    texts = land(texts.withColumn("rep", F.monotonically_increasing_id()))
    bits, tables = table_sizes(texts.count(), threshold, recall)
    keyed = land(
        texts.select("rep", "copies", "v").mapInArrow(
            bucket_keys(bits, tables), "rep long, copies long, v array<double>, keys array<long>"
        )
    )
    met = keyed.select("rep", F.explode("keys").alias("key"))
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(9)), F.col("n_blocks")).cast("int")
    met = met.join(sizes.select("key", n_blocks.alias("n_blocks")), "key").withColumn("block", own)
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    dealt = dealt.select(
        "rep", "key", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")
    )
    compared = land(
        dealt.join(keyed, "rep")
        .select("key", "b1", "b2", "block", "rep", "copies", "v", "keys")
        .groupBy("key", "b1", "b2")
        .applyInPandas(compare_buckets(threshold), "rep long, other long, n long")
    )
    n_links = compared.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    classes = components(compared.where("other is not null").select("rep", "other"))
    classed = land(
        texts.drop("v")
        .join(n_links, "rep", "left")
        .join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .withColumn("class", F.coalesce("component", "rep"))
    )
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    by_vector = classed.join(least, "class").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = rows.where("v is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    found = rows.where("v is not null").select("vec_id", "h1", "h2").join(by_vector, ["h1", "h2"])
    found = found.select("vec_id", "n_links", "component_id").union(alone)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
