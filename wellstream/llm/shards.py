"""Sharding by jump consistent hashing, in SQL functions only.

The shard of a key is where a pseudo-random walk over shard counts last jumped before it passed the count, so adding a
shard moves keys only into the new one, and no table of shards is kept. The walk is the published one: a 64-bit linear
congruential generator seeded with the key.

The key is doc_id; a row without one is keyed by the CRC-32 of its text. Equal keys share a shard. Null text has no bytes
and the CRC-32 of an empty text. Slots number the rows of a shard from 0 by doc_id (null first), CRC-32 and size. They
are counted range by range of doc_id, so that no shard is one task. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.llm.common import packed, unpacked
from wellstream.llm.order_minhash import number_below

SHARDS = 40
OVERHEAD_BYTES = 16
#: Fixed values of the published algorithm.
MULTIPLIER, INCREMENT = 2862933555777941757, 1
#: Rows that a range of doc_id aims at; ranges follow from the number of rows.
RANGE_ROWS = 500_000
MOST_RANGES = 100_000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (from 0) of a 64-bit key among so many shards, and among one more: a struct (shard, grown)."""
    wide = lambda x: x.cast("decimal(38,0)")
    word = F.lit(str(2**64)).cast("decimal(38,0)")
    unsigned = F.when(key < 0, wide(key) + word).otherwise(wide(key))
    start = F.struct(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), F.lit(0).cast("long").alias("next"), unsigned.cast("decimal(20,0)").alias("state"))

    def step(s: Column, _: Column) -> Column:
        product = s["state"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")
        state = ((product.cast("decimal(38,0)") + F.lit(INCREMENT)) % word).cast("decimal(20,0)")
        high = F.floor(state / F.lit(str(2**33)).cast("decimal(10,0)")).cast("double") + 1
        jumped = F.floor((s["next"] + 1) * (F.lit(float(2**31)) / high)).cast("long")
        within, grown = s["next"] < shards, s["next"] <= shards
        return F.struct(
            F.when(within, s["next"]).otherwise(s["shard"]).alias("shard"),
            F.when(grown, s["next"]).otherwise(s["grown"]).alias("grown"),
            F.when(grown, jumped).otherwise(s["next"]).alias("next"),
            F.when(grown, state).otherwise(s["state"]).alias("state"),
        )

    # every jump goes at least one shard on
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def sharded(documents: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with size, text_crc32, law, shard, slot, grown_shard (with one shard more), from which shards can be written.

    Columns of the input with one of these names are replaced; others may have any name.
    """
    return unpacked(_sharded(packed(documents), shards, f"row.`{doc_id}`", f"row.`{text}`"), *RESULTS)


def _sharded(documents: DataFrame, shards: int, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select("row", F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + OVERHEAD_BYTES).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("to", jump_hash(F.coalesce("doc_id", "text_crc32"), shards)).select("row", "doc_id", "size", "text_crc32", "to.shard", F.col("to.grown").alias("grown_shard"))
    total = documents.count()
    ranges = max(1, min(-(-total // RANGE_ROWS), MOST_RANGES))
    ends = documents.select(F.percentile_approx(F.col(doc_id).cast("long"), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    rows = rows.withColumn("part", number_below("doc_id", sorted({*(ends or [])})).cast("int"))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # one row per shard and range
    offsets = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")))
    out = numbered.join(offsets, ["shard", "part"])
    return out.select("row", "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")


def summary(documents: DataFrame) -> DataFrame:
    """Every document in shards 0 to 39."""
    return sharded(documents.select("doc_id", "text")).drop("text")
