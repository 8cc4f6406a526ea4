"""A Bloom filter of keys as one row of words, built and tested with built-in expressions.

It is put on a scan before an exact join on the same key, so that what the join shuffles is
about the matching part of the scanned side and not all of it (C2, C3, J1).  Its size is
bounded by ``MAX_BITS`` (8 MB), so it can be broadcast whatever the number of keys; with so
many keys that it lets most rows pass, it saves less, and the join decides all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS, BITS_A_KEY, HASHES = 1 << 26, 12, 4


def filter_bits(n_keys: int) -> int:
    """Bits for so many keys: a power of two, 64 at least and MAX_BITS at most."""
    return min(MAX_BITS, max(64, 1 << (BITS_A_KEY * n_keys - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(HASHES)]


def key_filter(keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """One row: ``words``, the filter of the values of ``key``, and ``bits``.  Bits are OR-ed
    map-side by word."""
    bits = filter_bits(n_keys)
    spots = keys.where(F.col(key).isNotNull()).select(
        F.explode(F.array(*_places(F.col(key), bits))).alias("at"))
    word = F.expr("at div 64").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = spots.select(word, bit.alias("bit")).groupBy("word").agg(
        F.bit_or("bit").alias("bit"))
    every = keys.sparkSession.range(bits // 64).select(
        F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit")).unionByName(words)
    every = every.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"])
    return every.agg(packed.alias("words"), F.lit(bits).cast("bigint").alias("bits"))


def may_have(rows: DataFrame, key: str, sieve: DataFrame, n_keys: int) -> DataFrame:
    """The rows whose ``key`` may be in the filter: all that are, and few that are not."""
    cols, bits = rows.columns, filter_bits(n_keys)
    one = F.broadcast(sieve.select(F.col("words").alias("_words"), F.lit(1).alias("_one")))
    hit = F.lit(True)
    for at in _places(F.col(key), bits):
        word = F.get("_words", F.floor(at / 64).cast("int"))
        hit = hit & (F.call_function("bit_get", word, (at % 64).cast("int")) == 1)
    return rows.withColumn("_one", F.lit(1)).join(one, "_one").where(hit).select(*cols)


def matching_rows(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """``rows`` joined with ``keys`` (one row a key) on ``key``; of ``rows`` only what the
    filter of the keys lets pass is shuffled."""
    sieve = key_filter(keys.select(key), key, n_keys)
    return may_have(rows, key, sieve, n_keys).join(keys, key)
