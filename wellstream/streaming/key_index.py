"""Bloom filters of the keys that a batch stored, one for each bucket, so that a lookup opens few files (S3).

A filter is a map of 64-bit words; its size follows from the number of keys in its bucket. A lookup tests the keys of a
batch against the filters of their buckets and names the files that may hold one. A bucket with more than PROBES keys to look up
isn't tested: all its files are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellstream.streaming.ledger import BUCKET

HASHES = 6
BITS_PER_KEY = 12
MOST_BITS = 1 << 23
PROBES = 1000

INDEX_SCHEMA = T.StructType([
    T.StructField(BUCKET, T.IntegerType()), T.StructField("bits", T.LongType()), T.StructField("words", T.MapType(T.LongType(), T.LongType())),
])


def _positions(key_hash: Column, bits: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda i: F.pmod(F.xxhash64(i, key_hash), bits))


def build(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One filter for each bucket of (bucket, keys)."""
    hashed = rows.select(BUCKET, F.xxhash64(*keys).alias("h"))
    wanted = F.least(F.lit(MOST_BITS), F.greatest(F.lit(64), F.expr(f"shiftleft(1L, int(ceil(log2(n * {BITS_PER_KEY}))))")))
    sizes = hashed.groupBy(BUCKET).agg(F.count("*").alias("n")).select(BUCKET, wanted.cast("long").alias("bits"))
    places = hashed.join(F.broadcast(sizes), BUCKET).select(BUCKET, "bits", F.explode(_positions(F.col("h"), F.col("bits"))).alias("p"))
    word = F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("value")
    words = places.groupBy(BUCKET, "bits", F.expr("p div 64").alias("word")).agg(word)
    return words.groupBy(BUCKET, "bits").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("words"))


def _may_hold(key_hash: Column, bits: Column, words: Column) -> Column:
    def is_set(p: Column) -> Column:
        word = F.coalesce(F.try_element_at(words, F.floor(p / 64).cast("long")), F.lit(0).cast("long"))
        return F.getbit(word, (p % 64).cast("int")) == 1

    return F.forall(_positions(key_hash, bits), is_set)


def candidates(index: DataFrame, wanted: DataFrame, keys: list[str]) -> list[str]:
    """Folders ``batch_id=N/attempt=K/bucket=B`` that may hold one of the wanted (bucket, keys).

    index: filters with batch_id and attempt. At most as many rows as there are buckets are broadcast.
    """
    hashed = wanted.select(BUCKET, F.xxhash64(*keys).alias("h")).distinct()
    first = F.slice(F.array_sort(F.collect_list("h")), 1, PROBES)
    counts = {r[BUCKET]: r.n for r in hashed.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    tested = [b for b, n in counts.items() if n <= PROBES]
    probes = hashed.where(F.col(BUCKET).isin(tested)).groupBy(BUCKET).agg(first.alias("probes"))
    met = index.where(F.col(BUCKET).isin(list(counts))).join(F.broadcast(probes), BUCKET, "left")
    may = F.col("probes").isNull() | F.exists("probes", lambda h: _may_hold(h, F.col("bits"), F.col("words")))
    return [f"batch_id={r.batch_id}/attempt={r.attempt}/{BUCKET}={r[BUCKET]}" for r in met.where(may).select("batch_id", "attempt", BUCKET).distinct().collect()]
