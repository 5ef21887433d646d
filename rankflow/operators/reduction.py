"""Semi-join reduction: cut a large table to the keys that are asked for before it is shuffled.

Three ways give the same rows; the measured size of the distinct keys decides. Keys that fit in a broadcast are
broadcast. For more keys, a Bloom filter of all of them is: a table of 64-bit words, one for each group
of keys with the same hash prefix, built by a partial and a final bit_or, so that only words reach one place. A
row whose word lacks a bit has no key among them; only the rest, the true ones and a few per cent, is shuffled for
the exact semi join. Where even the filter has no room for bits enough, the exact join stands alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.session import land

# Keys of a few bytes each that are broadcast: about 100 bytes each in memory.
BROADCAST_KEYS = 2_000_000
# Bytes of a broadcast table of keys or of filter words, in memory.
BROADCAST_BYTES = 200 << 20
_KEY_BYTES, _WORD_BYTES = 80, 64
# Keys to a word of the filter at best, and at worst (where a third of other rows passes).
KEYS_PER_WORD, MOST_KEYS_PER_WORD = 6, 24
_BITS = 4


def landed_keys(
    keys: DataFrame, column: str, broadcast_keys: int = BROADCAST_KEYS
) -> tuple[DataFrame, bool]:
    """The distinct values of ``column``, landed, and whether they are few enough to broadcast."""
    wanted = distinct_keys(keys, column)
    return wanted, wanted.limit(broadcast_keys + 1).count() <= broadcast_keys


def distinct_keys(keys: DataFrame, column: str) -> DataFrame:
    """The distinct values of ``column`` without null, landed."""
    return land(keys.select(column).where(F.col(column).isNotNull()).distinct())


def _word_and_bits(column: str, n_words: int) -> tuple[Column, Column]:
    """The word of a key and its bits in it, from separate parts of one hash."""
    h = F.xxhash64(column)
    word = F.pmod(F.shiftrightunsigned(h, 6 * _BITS), F.lit(n_words))
    bits = [F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(_BITS)]
    return word, reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits])


def bloom_words(wanted: DataFrame, column: str, n_words: int) -> DataFrame:
    """(word, bits) of all keys; at most ``n_words`` rows."""
    word, bits = _word_and_bits(column, n_words)
    return wanted.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))


def bloom_filtered(rows: DataFrame, wanted: DataFrame, column: str, n_words: int) -> DataFrame:
    """The rows whose key may be among ``wanted``; all true ones, without a shuffle of ``rows``."""
    words = land(bloom_words(wanted, column, n_words))
    word, bits = _word_and_bits(column, n_words)
    has_all = F.col("_bits").bitwiseAND(bits) == bits
    # Bounded: n_words rows of two longs. A semi join: Catalyst would move the exact one below an inner join.
    return rows.join(F.broadcast(words), (word == F.col("_word")) & has_all, "left_semi")


def keep_keys(
    rows: DataFrame, keys: DataFrame, column: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows whose ``column`` occurs in ``keys``; neither broadcast is larger than ``broadcast_bytes``."""
    return keep_distinct_keys(rows, distinct_keys(keys, column), column, broadcast_bytes)


def keep_distinct_keys(
    rows: DataFrame, wanted: DataFrame, column: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``keep_keys`` for a landed table of distinct keys without null."""
    size = F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))
    n, n_bytes = wanted.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if n_bytes + n * _KEY_BYTES <= broadcast_bytes:
        return rows.join(F.broadcast(wanted), column, "left_semi")
    n_words = min(-(-n // KEYS_PER_WORD), broadcast_bytes // _WORD_BYTES)
    if n_words and n <= n_words * MOST_KEYS_PER_WORD:
        rows = bloom_filtered(rows, wanted, column, n_words)
    return rows.join(wanted, column, "left_semi")
