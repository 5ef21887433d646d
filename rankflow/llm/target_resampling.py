"""Draw the documents whose words are most like those of a target, with Gumbel noise.

Features are all words and pairs of neighbouring words, hashed into a fixed number of buckets. The counts of
both sides give each bucket a gain: by how much a feature in it is likelier in the target. A document's
features are an array of bucket numbers, which is scored by one array of gains: the weight is their mean, and
noise that depends on the id alone is added. The highest scores are drawn.

The cut is found by bisection: the scores are persisted, and exact counts of the rows before some values
narrow the range of the k-th row's score, then of the id among the rows that tie at it, then of the number of
features and of the row number. So no task sorts all documents, and a score or an id that many rows share is
no group anywhere. Only the rows drawn are range-partitioned to number them.

A null or empty text has no words, no features and weight 0. A null doc_id counts as the least id, and its
noise is that of the empty string. Repeated rows are drawn and returned one by one. Without documents, or
without one of enough words, nothing is drawn; an empty target still gives gains. Other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.operators.numbering import dense_ordinal
from rankflow.session import land

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Counts that one job of the bisection makes.
CUTS_PER_JOB = 15
_LEAST = -(1 << 63)
#: The order of the draw, ascending; the last one is unique.
_ORDER = ("_first", "_id", "n_features", "_row")


def words_of(text: Column) -> Column:
    """The words of a whole text, with A-Z alone lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def feature_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of every word and of every pair of neighbours, repeats included."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature) % buckets).cast("int")

    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    two = F.zip_with(
        F.slice(words, F.lit(1), pairs), F.slice(words, F.lit(2), pairs), lambda a, b: bucket(F.concat_ws(" ", a, b))
    )
    return F.concat(F.transform(words, bucket), two)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall in each bucket; one number per bucket reaches the driver."""
    words = texts.select(words_of(F.col("text")).alias("words"))
    found = words.select(F.explode(feature_buckets(F.col("words"), buckets)).alias("bucket"))
    counts = [0] * buckets
    for row in found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(p / q)) of every bucket, with one count added to each."""
    n_raw, n_target = float(sum(raw) + len(raw)), float(sum(target) + len(target))
    return [
        math.floor(1000 * math.log((t + 1.0) * n_raw / ((s + 1.0) * n_target)))
        for s, t in zip(raw, target, strict=True)
    ]


def _mean_gain(found: Column, gains: list[int]) -> Column:
    # One foldable array instead of a column per gain.
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    total = F.aggregate(found, F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))
    n = F.size(found).cast("long")
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def gumbel_noise(ident: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), with u from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def target_scores(docs: DataFrame, target: DataFrame, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of ``docs``."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    ident = F.col("doc_id").cast("long")
    found = docs.select(ident.alias("doc_id"), words_of(F.col("text")).alias("words"))
    found = found.select("doc_id", F.size("words").alias("n_words"), feature_buckets(F.col("words"), buckets).alias("found"))
    weighed = found.select(
        "doc_id", "n_words", F.size("found").cast("long").alias("n_features"), _mean_gain(F.col("found"), gains).alias("weight")
    )
    return weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))


def _kth_value(rows: DataFrame, column: str, k: int) -> tuple[int, int, int]:
    """(value of the k-th least row, rows below it, rows at it), by exact counts; there are k rows at least."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    below = 0
    while low < high:
        step = max(1, (high - low + 1) // (CUTS_PER_JOB + 1))
        cuts = [c for c in (low + i * step - 1 for i in range(1, CUTS_PER_JOB + 1)) if c < high]
        counts = rows.agg(*[F.count_if(F.col(column) <= F.lit(c)) for c in cuts]).first()
        for cut, n in zip(cuts, counts, strict=True):
            if n >= k:
                high = cut
                break
            low, below = cut + 1, n
    below = rows.where(F.col(column) < F.lit(low)).count()
    return low, below, rows.where(F.col(column) == F.lit(low)).count()


def first_rows(rows: DataFrame, order: tuple[str, ...], k: int) -> Column:
    """Whether a row is one of the first k in the ascending order of some columns of longs without nulls.

    Each column is bisected among the rows that tie in the columns before it, until all ties are taken.
    """
    if k <= 0:
        return F.lit(False)
    taken, tied = F.lit(False), F.lit(True)
    for column in order:
        value, below, at = _kth_value(rows.where(tied), column, k)
        taken = taken | (tied & (F.col(column) < F.lit(value)))
        tied = tied & (F.col(column) == F.lit(value))
        k -= below
        if at == k:
            break
    return taken | tied


def resample_to_target(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; undrawn rows have no rank.

    Of the N rows with at least ``least_words`` words the floor(percent N / 100) highest scores are drawn,
    ties to the smaller doc_id, then to fewer features. Both tables hold a column ``text``.
    """
    scored = target_scores(docs, target, seed, buckets)
    scored = land(
        scored.withColumns(
            {
                "_first": -F.col("score"),
                "_id": F.coalesce("doc_id", F.lit(_LEAST)),
                "_row": F.monotonically_increasing_id(),
            }
        )
    )
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    drawn = F.coalesce((F.col("n_words") >= least_words) & first_rows(able, _ORDER, k), F.lit(False))
    result = ("doc_id", "n_features", "weight", "score", "rank")
    ranked = dense_ordinal(scored.where(drawn), _ORDER, "_ordinal").withColumn("rank", F.col("_ordinal") + 1)
    rest = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*result).unionByName(rest.select(*result))
