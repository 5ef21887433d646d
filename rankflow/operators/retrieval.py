"""BM25 retrieval as table operations.

The index is one row per document: ``doc_id, doc_length, terms array<struct<term, tf>>``. A
document is one row of the corpus, so its terms are counted inside the row and building the index
needs no shuffle. Rows with the same id are one document to a search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.text import tokens
from rankflow.operators.batches import known_postings, posting_slices, whole_documents
from rankflow.operators.reduction import BROADCAST_KEYS, landed_keys
from rankflow.session import land

# Default parameters of the public BM25 implementation, and its run-file precision.
K1 = 0.9
B = 0.4
SCORE_DIGITS = 6

# Query weights that go to every task at once; each takes its term and about so many bytes more.
_BLOCK_BYTES = 64 << 20
_WEIGHT_BYTES = 40
# Rows of the in-task top-k buffer, postings that are looked up and term scores that are summed at a time.
_BUFFER_ROWS = 2_000_000
_CHUNK_POSTINGS = 250_000
_CHUNK_ROWS = 500_000
# Rows of one query that one task ranks.
_ROWS_PER_GROUP = 10_000_000


def _runs(df: DataFrame, items: Column, key) -> DataFrame:
    """Sort an array column and mark where each run of equal keys starts."""
    df = df.withColumn("_sorted", F.sort_array(items))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_sorted")),
        lambda i: (i < F.size("_sorted"))
        & ((i == 0) | (key(F.get("_sorted", i)) != key(F.get("_sorted", i - 1)))),
    )
    return df.withColumn("_starts", starts)


def _run_length(start: Column, number: Column) -> Column:
    return F.coalesce(F.get("_starts", number + 1), F.size("_sorted")) - start


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))


def remove_stop_words(terms: DataFrame, stop_words: DataFrame) -> DataFrame:
    return terms.join(stop_words, "term", "left_anti")


def doc_vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index: document length and frequency of each term, counted inside the row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("_tokens"))
    rows = _runs(rows, F.col("_tokens"), lambda x: x)
    terms = F.transform(
        "_starts",
        lambda start, i: F.struct(
            F.get("_sorted", start).alias("term"), _run_length(start, i).alias("tf")
        ),
    )
    return rows.select("doc_id", F.size("_sorted").alias("doc_length"), terms.alias("terms"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, doc_id, tf, positions``; grouped by term only where a reader asks for it."""
    found = F.transform(
        tokens(F.col(text_col)), lambda t, i: F.struct(t.alias("term"), i.alias("pos"))
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("_tokens"))
    rows = _runs(rows, F.col("_tokens"), lambda x: x["term"])
    entries = F.transform(
        "_starts",
        lambda start, i: F.struct(
            F.get("_sorted", start)["term"].alias("term"),
            _run_length(start, i).alias("tf"),
            F.transform(
                F.slice("_sorted", start + 1, _run_length(start, i)), lambda x: x["pos"]
            ).alias("positions"),
        ),
    )
    rows = rows.select("doc_id", F.explode(entries).alias("e"))
    return rows.select(F.col("e.term"), "doc_id", F.col("e.tf"), F.col("e.positions"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """Number of documents with at least one term, and their average length."""
    return index.where("doc_length > 0").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_length").alias("avg_length")
    )


def document_frequency(
    index: DataFrame, vocabulary: DataFrame | None = None, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Documents per term; the partial counts leave a hot term one row per task to shuffle.

    A small vocabulary is applied before counting, a large one to the counts.
    """
    terms = index.select(F.explode("terms.term").alias("term"))
    if vocabulary is None:
        return _count_terms(terms)
    wanted, few = landed_keys(vocabulary, "term", broadcast_keys)
    if few:
        return _asked_frequency(index, wanted)
    return _count_terms(terms).join(wanted, "term", "left_semi")


def _asked_frequency(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents per term of a table of distinct terms that is small enough to go to every task."""
    terms = index.select(F.explode("terms.term").alias("term"))
    return _count_terms(terms.join(F.broadcast(wanted), "term", "left_semi"))


def _count_terms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """``query_index, term, qtf``; a repeated word counts as often as it is asked for."""
    terms = token_counts(queries, "query_index", "query_text")
    if stop_words is not None:
        terms = remove_stop_words(terms, stop_words)
    return terms.groupBy("query_index", "term").agg(F.count(F.lit(1)).alias("qtf"))


def unique_documents(index: DataFrame) -> DataFrame:
    """The index with one row per id: rows that share an id are one document, null ids are left out.

    Only ids are shuffled to find such rows, and only the rows found are merged. A merged document
    has at most one entry per term of the vocabulary.
    """
    merged = _merged_documents(index)
    return _identified(index) if merged is None else merged


def _identified(index: DataFrame) -> DataFrame:
    return index.where(F.col("doc_id").isNotNull()).select("doc_id", "doc_length", "terms")


def _merged_documents(index: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame | None:
    """The index with repeated ids merged; None if no id repeats.

    With a small ``vocabulary`` (term) merged documents have its terms only, and no others are shuffled.
    """
    index = _identified(index)
    repeated = index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    repeated = land(repeated.select("doc_id"))
    if repeated.isEmpty():
        return None
    rows = index.join(repeated, "doc_id", "left_semi")
    lengths = rows.groupBy("doc_id").agg(F.sum("doc_length").cast("int").alias("doc_length"))
    terms = rows.select("doc_id", F.explode("terms").alias("t")).select("doc_id", "t.term", "t.tf")
    if vocabulary is not None:
        terms = terms.join(F.broadcast(vocabulary), "term", "left_semi")
    terms = terms.groupBy("doc_id", "term")
    terms = terms.agg(F.sum("tf").cast("int").alias("tf")).groupBy("doc_id")
    terms = terms.agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    none = F.array().cast(index.schema["terms"].dataType)
    merged = lengths.join(terms, "doc_id", "left").withColumn("terms", F.coalesce("terms", none))
    return index.join(repeated, "doc_id", "left_anti").unionByName(merged.select(*index.columns))


@dataclass(frozen=True)
class Index:
    """What a search reads: documents with unique ids, document frequencies, and two numbers."""

    documents: DataFrame
    frequencies: DataFrame
    n_docs: int
    avg_length: float


def prepare(
    index: DataFrame, vocabulary: DataFrame | None = None, broadcast_keys: int = BROADCAST_KEYS
) -> Index:
    """Count terms and lengths once, for any number of searches; merged documents are merged once, and landed.

    With a ``vocabulary`` (term) the searches may ask for its terms only. Up to ``broadcast_keys`` terms, no others
    are merged and counted.
    """
    if vocabulary is not None:
        wanted, few = landed_keys(vocabulary, "term", broadcast_keys)
        vocabulary = wanted if few else None
    merged = _merged_documents(index, vocabulary)
    documents = _identified(index) if merged is None else land(merged)
    counted = document_frequency(documents) if vocabulary is None else _asked_frequency(documents, vocabulary)
    return with_counts(documents, land(counted))


def with_counts(documents: DataFrame, frequencies: DataFrame) -> Index:
    stats = corpus_stats(documents).first()
    return Index(documents, frequencies, stats["n_docs"], stats["avg_length"] or 1.0)


def query_weights(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query_index, term, weight`` and the two numbers of the length norm, all a score needs."""
    n_docs = F.lit(index.n_docs)
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return terms.join(index.frequencies, "term").select(
        "query_index",
        "term",
        (F.col("qtf") * idf).alias("weight"),
        F.lit(k1 * (1 - b)).alias("norm_base"),
        F.lit(k1 * b / index.avg_length).alias("norm_per_term"),
    )


def _sum_by_pair(pair: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the scores of equal pairs; by counting where pairs are dense, by sorting elsewhere."""
    low = pair.min()
    cells = pair.max() - low + 1
    if cells <= 4 * len(pair):
        total = np.bincount(pair - low, weights=score, minlength=cells)
        found = np.flatnonzero(total)  # a term score is never zero
        return found + low, total[found]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    return pair[first], np.add.reduceat(score[order], first)


class _Best:
    """The best k rows per query of one task, in a buffer that is cut when it is full.

    Scores are rounded before they are compared, as in the final ranking, so a dropped row is
    always behind k rows of the same task.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.limit = min(_BUFFER_ROWS, max(_BUFFER_ROWS // 20, 4 * k * n_queries))
        self.parts: list[pd.DataFrame] = []
        self.size = 0
        self.least = np.full(n_queries, -np.inf)

    def add(self, query: np.ndarray, doc_id: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[query]
        rows = {"query": query[keep], "doc_id": doc_id[keep], "score": score[keep]}
        self.parts.append(pd.DataFrame(rows))
        self.size += len(self.parts[-1])
        if self.size > self.limit:
            self.cut()

    def cut(self) -> None:
        rows = pd.concat(self.parts, ignore_index=True)
        rows = rows.sort_values(["query", "score", "doc_id"], ascending=[True, False, True])
        place = rows.groupby("query", sort=False).cumcount()
        last = rows[place == self.k - 1]
        self.least[last["query"]] = last["score"]
        self.parts = [rows[place < self.k]]
        self.size = len(self.parts[0])

    def take(self) -> pd.DataFrame:
        self.cut()
        rows, self.parts, self.size = self.parts[0], [], 0
        return rows


def _score_documents(shared: Broadcast, k: int, digits: int):
    """Score whole documents against all query weights and keep the best k per query of a task."""

    def score_batch(batch: pa.RecordBatch, best: _Best) -> None:
        query = shared.value
        doc, term, tf = known_postings(batch.column("terms"), query["terms"])
        length = batch.column("doc_length").to_numpy(zero_copy_only=False)[doc]
        gain = tf / (tf + query["norm_base"] + query["norm_per_term"] * length)
        start = query["starts"][term]
        size = query["starts"][term + 1] - start
        ids = batch.column("doc_id").to_pandas().to_numpy()
        for c in whole_documents(size, doc, _CHUNK_ROWS):
            n = size[c]
            # For each posting the weights of its term, one after another.
            at = np.arange(n.sum()) + np.repeat(start[c] - (n.cumsum() - n), n)
            pair = np.repeat(doc[c].astype(np.int64), n) * query["n"] + query["query"][at]
            pair, score = _sum_by_pair(pair, query["weight"][at] * np.repeat(gain[c], n))
            best.add(pair % query["n"], ids[pair // query["n"]], score.round(digits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = shared.value
        best = _Best(query["n"], k)

        def taken() -> pa.RecordBatch:
            rows = best.take()
            rows.insert(0, "query_index", query["ids"][rows.pop("query")])
            return pa.RecordBatch.from_pandas(rows, preserve_index=False)

        for batch in batches:
            for part in posting_slices(batch, _CHUNK_POSTINGS):
                score_batch(part, best)
                if best.size > best.limit // 2:
                    best.cut()
                if best.size > best.limit // 2:  # so many queries that k rows of each are too many
                    yield taken()
            pa.default_memory_pool().release_unused()
        if best.parts:
            yield taken()

    return run


def _packed(weights: pd.DataFrame) -> dict:
    """Weights by term: ``starts[t]`` to ``starts[t + 1]`` are the queries that ask for term t."""
    weights = weights.sort_values(["term", "query_index"])
    terms, first = np.unique(weights["term"].to_numpy(dtype=object), return_index=True)
    ids, query = np.unique(weights["query_index"].to_numpy(), return_inverse=True)
    return {
        "terms": pa.array(terms, pa.string()),
        "starts": np.r_[first, len(weights)].astype(np.int64),
        "ids": ids,
        "n": len(ids),
        "query": query.astype(np.int64),
        "weight": weights["weight"].to_numpy(dtype=float),
        "norm_base": float(weights["norm_base"].iloc[0]),
        "norm_per_term": float(weights["norm_per_term"].iloc[0]),
    }


def top_k(
    scores: DataFrame,
    k: int,
    group: str = "query_index",
    ident: str = "doc_id",
    salts: int = 1,
) -> DataFrame:
    """The k best rows per group, ranked from 1 in ``hit``; ties go to the smaller id.

    Up to a limit on k, Spark itself cuts every partition to k rows per group before the shuffle.
    Above that, or with ``salts``, a first window over salted groups does so.
    """
    spark = scores.sparkSession
    if k > int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salts = max(salts, spark.sparkContext.defaultParallelism)
    order = [F.desc("score"), F.asc(ident)]
    if salts > 1:
        salted = scores.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
        salted = salted.repartition(group, "_salt")
        first = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))
        scores = salted.withColumn("_hit", first).where(F.col("_hit") <= k).drop("_hit", "_salt")
        scores = scores.repartition(group)
    hit = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return scores.withColumn("hit", hit).where(F.col("hit") <= k)


def bm25_search(
    index: Index | DataFrame,
    queries: DataFrame,
    k: int = 1000,
    stop_words: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
    block_bytes: int = _BLOCK_BYTES,
) -> DataFrame:
    """The run table ``query_index, doc_id, hit, score`` with the k best documents per query.

    ``index`` is a prepared index or a table of ``doc_vectors``; rows with the same id are one
    document. The query weights are landed and cut into blocks of about ``block_bytes``, each query in
    one block. A block goes to every task: a document is one row of the index, so a task scores whole
    documents and passes on k rows per query, and what is shuffled does not grow with the number
    of (query, document) matches. The index is scanned once per block. Where there are several blocks, the
    hits of each are landed and its weights are given up before the next one is sent.
    """
    terms = query_terms(queries, stop_words)
    if isinstance(index, DataFrame):
        index = prepare(index, terms)
    spark = index.documents.sparkSession
    weights = land(query_weights(index, terms, k1, b))
    size = weights.agg(F.sum(F.octet_length("term") + _WEIGHT_BYTES)).first()[0] or 0
    n_blocks = math.ceil(size / block_bytes)
    doc_id = index.documents.schema["doc_id"].dataType.simpleString()
    run = f"query_index long, doc_id {doc_id}, score double"
    documents = index.documents.where("doc_length > 0")
    parts = []
    for block in range(n_blocks):
        mine = weights.where(F.pmod(F.xxhash64("query_index"), F.lit(n_blocks)) == block).toPandas()
        if len(mine):
            shared = spark.sparkContext.broadcast(_packed(mine))
            found = documents.mapInArrow(_score_documents(shared, k, SCORE_DIGITS), run)
            parts.append(found if n_blocks == 1 else land(found))
            if n_blocks > 1:
                shared.destroy()
    scores = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], run)
    # A query has at most k rows of each task, and no more rows than there are documents.
    salts = math.ceil(index.n_docs / _ROWS_PER_GROUP)
    salts = min(max(salts, 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return top_k(scores, k, salts=salts).select("query_index", "doc_id", "hit", "score")
