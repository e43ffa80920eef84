"""Idempotency, order and outcome of arriving readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.operators.slices import ARRIVALS_PER_SLICE, SLICE, balanced, slice_start, slice_window, with_carried
from wellstream.schemas import (
    BASELINE, CONFLICT, CONTENT_COLUMNS, DUPLICATE, GAP, IN_ORDER, LATE_ARRIVAL, NATURAL_KEY, OUT_OF_ORDER,
    PUBLISHED, STORED, STREAM_KEY,
)

ADVANCING = [BASELINE, IN_ORDER, GAP]


def partition_streams(
    readings: DataFrame, partitions: int, arrivals_per_slice: int = ARRIVALS_PER_SLICE
) -> DataFrame:
    """O1: hash partitions that keep consecutive arrivals of one stream together.

    A stream larger than a slice continues in another partition instead of filling one task.
    """
    return readings.withColumn(SLICE, slice_start(F.col("arrival_no"), arrivals_per_slice)).repartition(
        partitions, *STREAM_KEY, SLICE
    )


def same_content(first: Column) -> Column:
    """O3: null-safe equality of a reading with the first content stored under its natural key."""
    return F.struct(*CONTENT_COLUMNS).eqNullSafe(first)


def first_contents(readings: DataFrame) -> DataFrame:
    """First arrival and its content per natural key that arrived more than once.

    Repeated keys come from a hash aggregate of two numbers, which combines on the map side: a key that
    fills a third of the input leaves one row per map task. Contents are then fetched for these keys only.
    """
    repeated = (
        readings.groupBy(*NATURAL_KEY)
        .agg(F.min("arrival_no").alias("_first_arrival"), F.count(F.lit(1)).alias("_arrivals"))
        .where("_arrivals > 1")
        .drop("_arrivals")
    )
    contents = readings.select(
        *NATURAL_KEY, F.col("arrival_no").alias("_first_arrival"), F.struct(*CONTENT_COLUMNS).alias("_first_content")
    )
    return contents.join(repeated, [*NATURAL_KEY, "_first_arrival"])


def classify_copies(readings: DataFrame, arrivals: DataFrame | None = None) -> DataFrame:
    """O2: adds ``store_status``: Stored for the first arrival of a natural key, then Duplicate or Conflict.

    A join, not a window over the natural key: AQE splits the side with many copies of one key.
    ``arrivals`` are the same rows where ``readings`` already went through another operator; first contents
    are then taken from the plainer plan.
    """
    matched = readings.join(first_contents(readings if arrivals is None else arrivals), NATURAL_KEY, "left")
    status = (
        F.when(F.col("_first_arrival").isNull() | (F.col("arrival_no") == F.col("_first_arrival")), STORED)
        .when(same_content(F.col("_first_content")), DUPLICATE)
        .otherwise(CONFLICT)
    )
    return matched.withColumn("store_status", status).drop("_first_arrival", "_first_content")


def stored_only(readings: DataFrame) -> DataFrame:
    """First arrival per natural key: what insert-if-absent leaves in the table."""
    return (
        readings.groupBy(*NATURAL_KEY)
        .agg(F.min_by(F.struct(*CONTENT_COLUMNS, "received_at_utc", "arrival_no"), "arrival_no").alias("_first"))
        .select(*NATURAL_KEY, "_first.*")
        .select(*readings.columns)
    )


def first_arrivals(readings: DataFrame) -> DataFrame:
    """Key, receipt and arrival number of the same rows. Fixed-width buffers keep this a hash aggregate."""
    return readings.groupBy(*NATURAL_KEY).agg(
        F.min_by("received_at_utc", "arrival_no").alias("received_at_utc"), F.min("arrival_no").alias("arrival_no")
    )


def sequence_status(sequence: Column, last: Column) -> Column:
    return (
        F.when(last.isNull(), BASELINE)
        .when(sequence == last + 1, IN_ORDER)
        .when(sequence > last + 1, GAP)
        .when(sequence < last, OUT_OF_ORDER)
        .otherwise(DUPLICATE)
    )


def classify_sequence(
    readings: DataFrame, arrivals_per_slice: int = ARRIVALS_PER_SLICE, last_sequences: DataFrame | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Adds ``previous_sequence``, ``sequence_status`` and ``gap_size``.

    The previous sequence is the running maximum of the stream. Copies never move it, because their first
    arrival came before them; so this needs no knowledge of O2 and works on every arrival.
    ``last_sequences`` (stream key, last_sequence) continues from earlier input. ``rows_per_slice`` cuts streams by
    the density of their arrival numbers instead: for sparse or uneven numbers.
    """
    if rows_per_slice is None:
        sliced = readings.select("*", slice_start(F.col("arrival_no"), arrivals_per_slice).alias(SLICE))
    else:
        sliced = balanced(readings, STREAM_KEY, "arrival_no", "arrival_no", rows_per_slice)
    joined = with_carried(sliced, STREAM_KEY, {"_carried": (F.max("sequence_number"), "max")})
    window = slice_window(STREAM_KEY, "arrival_no").rowsBetween(Window.unboundedPreceding, -1)
    if last_sequences is not None:
        joined = joined.join(last_sequences, STREAM_KEY, "left")
        known = F.greatest("_carried", "last_sequence")
    else:
        known = F.col("_carried")
    last = F.greatest(known, F.max("sequence_number").over(window))
    out = joined.select(*readings.columns, last.alias("previous_sequence"))
    sequence, previous = F.col("sequence_number"), F.col("previous_sequence")
    status = sequence_status(sequence, previous)
    return out.select("*", status.alias("sequence_status"), F.when(status == GAP, sequence - previous - 1).alias("gap_size"))


def last_sequences(readings: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Highest sequence per stream, continued from ``earlier``."""
    seen = readings.select(*STREAM_KEY, F.col("sequence_number").alias("last_sequence"))
    if earlier is not None:
        seen = seen.unionByName(earlier)
    return seen.groupBy(*STREAM_KEY).agg(F.max("last_sequence").alias("last_sequence"))


def outcome(store_status: Column, status: Column) -> Column:
    """O5 as a column. Late arrivals are stored but not published, however late they are."""
    return (
        F.when(store_status != STORED, store_status)
        .when(status == OUT_OF_ORDER, LATE_ARRIVAL)
        .when(status == DUPLICATE, DUPLICATE)
        .otherwise(PUBLISHED)
    )


def judged(readings: DataFrame, classified: DataFrame) -> DataFrame:
    """O5 from rows that carry store and sequence status; copies lose the latter."""
    stored = F.col("store_status") == STORED
    return classified.select(
        *readings.columns,
        "store_status",
        F.when(stored, F.col("previous_sequence")).alias("previous_sequence"),
        F.when(stored, F.col("sequence_status")).alias("sequence_status"),
        F.when(stored, F.col("gap_size")).alias("gap_size"),
        outcome(F.col("store_status"), F.col("sequence_status")).alias("outcome"),
    )


def process(readings: DataFrame, arrivals_per_slice: int = ARRIVALS_PER_SLICE) -> DataFrame:
    """Every valid arrival with its store status, sequence status and processing outcome."""
    return judged(readings, classify_copies(classify_sequence(readings, arrivals_per_slice), readings))


def live_stream(readings: DataFrame, arrivals_per_slice: int = ARRIVALS_PER_SLICE) -> DataFrame:
    """Readings that advance their stream, in strictly rising sequence per stream.

    Advancing the running maximum implies being the first arrival of the key, so O2 is not needed.
    """
    return classify_sequence(readings, arrivals_per_slice).where(F.col("sequence_status").isin(ADVANCING))


def session_pair(left: Column, right: Column) -> Column:
    """The two sessions of a pair in one fixed order."""
    return F.struct(F.least(left, right).alias("first"), F.greatest(left, right).alias("second"))
