"""Quality by importance resampling: how much likelier target text makes a document than raw text.

Two hashed n-gram models are estimated over all documents: one on the target (documents labelled as
good), one on the raw corpus. A document's weight is the ratio of its probabilities in the two: the log ratios of
all its words and word pairs, summed. Documents are then drawn without replacement in proportion to their
weights: each gets its log weight plus Gumbel noise, and the largest values are kept (Gumbel top-k). So
the sample follows the target; ``weight="mean"`` takes the mean log ratio instead, which does not
depend on the length of a text.

Both models are tables of ``buckets`` counts whatever the corpus; the counts are added up in the tasks
and then by Spark. The cut of the k-th largest value is found by counting in finer and finer
ranges, so no task sorts all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.session import ready
from rankflow.llm.text_arrays import constants, mix, slices, words
from rankflow.operators.reduction import BROADCAST_KEYS, landed_keys
from rankflow.session import land

BUCKETS = 1 << 16


def ngram_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, and the row of each."""
    found = words(texts)
    n = np.diff(found.offsets)
    row = np.repeat(np.arange(len(n)), n)
    one = found.hashes % np.uint64(buckets)
    keys = constants(2, 30)
    pair = mix(found.hashes[:-1] * keys[0] + found.hashes[1:] * keys[1]) % np.uint64(buckets)
    same = row[:-1] == row[1:]
    both = np.concatenate([one, pair[same]]).astype(np.int64)
    return both, np.concatenate([row, row[:-1][same]])


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)  # raw, target
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, row = ngram_buckets(batch.column("text"), buckets)
                target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[target[row]], minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "raw", "target"]
        )

    return run


def ngram_ratios(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, broadcast_keys: int = BROADCAST_KEYS
) -> np.ndarray:
    """log(target / raw) of every bucket, with one count added to each; over all documents.

    The target is the documents with a quality label of 1; repeated labels count as 1 if any is 1.
    Up to ``broadcast_keys`` target ids are broadcast; beyond that the texts are shuffled once.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    good, few = landed_keys(good, "doc_id", broadcast_keys)
    good = good.withColumn("target", F.lit(True))
    marked = docs.join(F.broadcast(good) if few else good, "doc_id", "left")
    marked = marked.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_count(buckets), "bucket long, raw long, target long")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():  # one row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def _weigh(ratios: Broadcast, buckets: int, mean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, row = ngram_buckets(batch.column("text"), buckets)
                n = np.bincount(row, minlength=batch.num_rows)
                total = np.bincount(row, ratios.value[bucket], minlength=batch.num_rows)
                # Without words there is no evidence of quality: the least likely text.
                ratio = np.where(n > 0, total / np.maximum(n, 1) if mean else total, -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("same"), pa.array(ratio)], names=["doc_id", "same", "log_ratio"]
                )

    return run


def top_k_threshold(values: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(cut, extra): the k largest of a column of longs are those above cut and ``extra`` of those at it.

    Twelve bits of the values are settled per round: the rows that agree so far are counted by their
    next bits. There must be k rows at least.
    """
    ordered = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # in the order of unsigned numbers
    prefix, left, done = 0, k, 0
    for width in (12, 12, 12, 12, 12, 4):
        inside = values.where(F.shiftrightunsigned(ordered, 64 - done) == F.lit(prefix)) if done else values
        done += width
        digit = F.shiftrightunsigned(ordered, 64 - done).bitwiseAND(F.lit((1 << width) - 1))
        counts = inside.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["digit"]):
            if r["n"] >= left:
                prefix = (prefix << width) | r["digit"]
                break
            left -= r["n"]
        else:
            raise ValueError("there are fewer rows than asked for")
    return prefix - (1 << 63), left


def resample(
    docs: DataFrame, labels: DataFrame, share: float = 0.5, temperature: float = 1.0,
    buckets: int = BUCKETS, seed: int = 7, weight: str = "ratio",
) -> DataFrame:
    """(doc_id, log_ratio, gumbel_key, kept) for every row of ``docs``; ``share`` of the rows are kept.

    ``share`` is the feature of this operator: it draws a sample. ``log_ratio`` is the sum over a text's
    n-grams (with ``weight="mean"`` their mean), divided by ``temperature`` before the noise is added: 1 draws
    by the ratio itself, and a mean needs about 0.02 to tell texts apart. Texts without a word (null, empty)
    have a log_ratio of minus infinity and are kept only when the sample takes every other row.
    Repeated rows get different noise and are drawn one by one; rows with a null doc_id take part.
    Without good labels all weights are equal.
    """
    if weight not in ("ratio", "mean"):
        raise ValueError(f"weight is 'ratio' or 'mean', not {weight!r}")
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select("doc_id", "quality")
    ratios = spark.sparkContext.broadcast(ngram_ratios(docs, labels, buckets))
    same = F.monotonically_increasing_id()  # tells repeated rows apart; landed below
    weighed = land(
        docs.withColumn("same", same).mapInArrow(
            _weigh(ratios, buckets, weight == "mean"), "doc_id long, same long, log_ratio double"
        )
    )
    unnamed = F.when(F.col("doc_id").isNull(), F.col("same"))  # rows without an id are no group
    repeats = Window.partitionBy("doc_id", unnamed).orderBy("log_ratio", "same")
    numbered = weighed.withColumn("copy", F.row_number().over(repeats).cast("long")).withColumnRenamed("same", "_same")
    numbered = numbered.withColumn("copy", F.coalesce(F.when(F.col("doc_id").isNull(), F.col("_same")), "copy"))
    draw = F.xxhash64("doc_id", "copy", F.lit(seed)).cast("double") / F.lit(float(1 << 64)) + F.lit(0.5)
    noise = -F.log(-F.log(F.greatest(draw, F.lit(1e-12)) * F.lit(1 - 1e-12)))
    key = F.col("log_ratio") / F.lit(temperature) + noise
    keyed = numbered.withColumn("gumbel_key", F.when(F.col("log_ratio") == float("-inf"), F.lit(float("-inf"))).otherwise(key))
    # Keys as whole numbers: 2^-30 apart, and the least for minus infinity; ties are broken by hash.
    scaled = F.round(F.col("gumbel_key") * F.lit(float(1 << 30)))
    scaled = F.greatest(F.least(scaled, F.lit(float(1 << 61))), F.lit(-float(1 << 61)))  # 2 billion on either side
    rank = F.when(F.col("gumbel_key") == float("-inf"), F.lit(-(1 << 62))).otherwise(scaled.cast("long"))
    keyed = land(keyed.withColumn("_rank", rank).withColumn("_tie", F.xxhash64("doc_id", "copy", F.lit(seed + 1))))
    total = keyed.count()
    k = round(total * share)
    if k == 0 or total == 0:
        kept = F.lit(False)
    else:
        cut, extra = top_k_threshold(keyed, "_rank", k)
        tie_cut, _ = top_k_threshold(keyed.where(F.col("_rank") == F.lit(cut)), "_tie", extra)
        last = (F.col("_rank") == F.lit(cut)) & (F.col("_tie") >= F.lit(tie_cut))
        kept = (F.col("_rank") > F.lit(cut)) | last
    return keyed.select("doc_id", "log_ratio", "gumbel_key", kept.alias("kept"))
