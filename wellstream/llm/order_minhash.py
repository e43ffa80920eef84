"""Document fingerprints by Order MinHash.

A text is a sequence of code points; its elements are its k-mers, numbered by occurrence. Each of SAMPLES orders of the
elements picks the TUPLE smallest; their k-mers, in text order, are hashed to one value. Two texts agree in a value if
they share the same k-mers in the same order, so the share of equal values falls with the edit distance. The orders are
the rotations of one random order (hash - seed modulo 2^64): each is uniform, and all come from one sort.

The next document is found without a global sort: documents go to ranges of doc_id, and the first of each range is also
sent to the range before it. Ties on doc_id are ordered by text. A null doc_id comes before all others. Null text is
empty; empty texts have an empty fingerprint, alike to each other (1) and to no other text (0). A text shorter than a
k-mer is one element. A single document is its own next. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellstream.llm.common import mix, ship

KMER_CHARS = 5
TUPLE = 2
SAMPLES = 64
#: Texts of up to 2^24 code points keep 40 bits of each hash.
PLACE_BITS = 24
#: Rows that a range of doc_id aims at; ranges follow from the number of rows.
RANGE_ROWS = 20_000
MOST_RANGES = 100_000
_SEEDS = np.sort(mix(np.arange(101, 101 + SAMPLES, dtype=np.uint64)))
_FACTORS = mix(np.arange(1, KMER_CHARS + 1, dtype=np.uint64)) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def fingerprint(text: str) -> np.ndarray:
    """SAMPLES values of 32 bits; none for an empty text."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(chars):
        return np.empty(0, dtype=np.uint32)
    k = min(KMER_CHARS, len(chars))
    n = len(chars) - k + 1
    kmers = chars[:n] * _FACTORS[0]
    for j in range(1, k):
        kmers += chars[j : j + n] * _FACTORS[j]
    kmers = mix(kmers + np.uint64(k))
    # hash above, place below: one sort gives both; the hash must not depend on the length of the text
    low = np.uint64(max(PLACE_BITS, n.bit_length()))
    below = (np.uint64(1) << low) - np.uint64(1)
    packed = np.sort((kmers & ~below) | np.arange(n, dtype=np.uint64))
    ranked, place = packed >> low, packed & below
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if len(again):
        # occurrences count from the first of each run of equal k-mers
        new = np.ones(n, dtype=bool)
        new[again] = False
        begin = np.flatnonzero(new)
        occurrence = again - begin[np.searchsorted(begin, again) - 1]
        ranked[again] += occurrence.astype(np.uint64) * _ODD
    elements = ranked * _SPREAD
    elements ^= elements >> np.uint64(32)
    elements *= _ODD
    packed = np.sort((elements & ~below) | place)
    take = min(TUPLE, n)
    at = (np.searchsorted(packed, _SEEDS)[:, None] + np.arange(take)) % n
    places = np.sort((packed[at] & below).astype(np.int64), axis=1)
    value = np.full(SAMPLES, np.uint64(take))
    for j in range(take):
        value = mix(value * _ODD + kmers[places[:, j]])
    return (value >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.count_nonzero(a == b)) / SAMPLES


def as_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""
    ship(documents.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            prints = [as_text(fingerprint(x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def in_ranges(documents: DataFrame) -> DataFrame:
    """(slot, look, doc_id, text): rows of a range share a slot; with look, the row that follows the last of the slot.

    Only the ends and first ids of the ranges are held on the driver: at most MOST_RANGES numbers.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.count()
    wanted = max(-(-total // RANGE_ROWS), min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // 200))
    ranges = max(1, min(wanted, MOST_RANGES))
    ends = rows.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    slotted = rows.withColumn("slot", number_below("doc_id", sorted({*(ends or [])})))
    known = F.coalesce("doc_id", F.lit(-(2**63)))
    first = sorted((r.slot, r.least) for r in slotted.groupBy("slot").agg(F.min(known).alias("least")).collect())
    # the row that opens a range is also shown to the range before it; the first range follows the last one
    shown = spark.createDataFrame([(least, first[i - 1][0]) for i, (_, least) in enumerate(first)], "opens long, shown int")
    look = slotted.join(F.broadcast(shown), known == F.col("opens"), "left")
    own = F.struct(F.col("slot").cast("int").alias("slot"), F.lit(False).alias("look"))
    both = F.array(own, F.struct(F.col("shown").alias("slot"), F.lit(True).alias("look")))
    return look.select(F.explode(F.when(F.col("shown").isNull(), F.array(own)).otherwise(both)).alias("to"), "doc_id", "text").select("to.*", "doc_id", "text")


def number_below(column: str, ends: list[int]) -> Column:
    """How many of the ascending ends are below the column (null: none): first among groups of ends, then within one."""
    if not ends:
        return F.lit(0)
    width = math.isqrt(len(ends)) + 1
    groups = [ends[i : i + width] for i in range(0, len(ends), width)]
    heads = F.array(*[F.lit(int(g[-1])) for g in groups])
    group = F.size(F.filter(heads, lambda e: e < F.col(column)))
    within = F.filter(F.element_at(F.array(*[F.array(*[F.lit(int(e)) for e in g]) for g in groups]), F.least(group + 1, F.lit(len(groups)))), lambda e: e < F.col(column))
    below = F.when(group == len(groups), F.lit(len(ends))).otherwise(group * width + F.size(within))
    return F.coalesce(F.when(F.col(column).isNotNull(), below), F.lit(0))


def with_next(documents: DataFrame) -> DataFrame:
    """Per document of ascending doc_id: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document; the first follows the last.
    """
    rows = in_ranges(documents)
    rows = rows.repartition("slot").sortWithinPartitions("slot", "look", "doc_id", "text")
    ship(documents.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finished(doc: tuple, follower: tuple) -> tuple:
        doc_id, text, own = doc
        n = len(text)
        edited = text[: n - n // 4] + follower[1][: n // 4]
        other = own if edited == text else fingerprint(edited)
        return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, follower[2])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot = None, None
        for batch in source:
            out = []
            for s, look, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                s, look = s.as_py(), look.as_py()
                if held is not None and slot != s:
                    raise ValueError("a range lost the row that follows it")
                if look and held is None:
                    continue  # ties of the row that follows
                text = text.as_py()
                doc = (doc_id.as_py(), text, fingerprint(text))
                if held is not None:
                    out.append(finished(held, doc))
                held, slot = (None if look else doc), s
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
