"""Operational events (E1 to E8): what the stream operators found, as rows of the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellstream.functions.labels import run_label
from wellstream.schemas import EVENT_COLUMNS

DUPLICATE_READING = "DuplicateReading"
CONFLICTING_READING = "ConflictingReading"
SEQUENCE_GAP = "SequenceGap"
OUT_OF_ORDER_READING = "OutOfOrderReading"
INVALID_MESSAGE = "InvalidMessage"
CONCURRENT_SESSIONS = "ConcurrentAcquisitionSessions"

# Message texts of the events contract.
DUPLICATE_TEXT = "An identical reading was ignored."
CONFLICT_TEXT = "The sequence identity was reused with different telemetry content."
GAP_TEXT = "%d sequence positions were skipped after %d."
OUT_OF_ORDER_TEXT = "Sequence %d arrived after sequence %d had already been observed."
INVALID_TEXT = "An invalid telemetry message was rejected and sent to the dead-letter queue."
CONCURRENT_TEXT = (
    "%s is receiving telemetry from two active acquisition runs. Existing run %s, newly observed run %s."
)

# Position of an event among those of one arrival: concurrency is noticed before the sequence is judged.
RANK_CONCURRENT, RANK_READING = 0, 1


def event_id(event_type: Column, arrival_no: Column) -> Column:
    """UUID-shaped and derived from what happened, so that a replay writes the same event again."""
    digest = F.sha2(F.concat_ws("|", event_type, arrival_no.cast("string")), 256)
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _shape(df: DataFrame, rank: int) -> DataFrame:
    return df.select(
        event_id(F.col("event_type"), F.col("arrival_no")).alias("event_id"),
        *EVENT_COLUMNS[1:-1],
        F.col("received_at_utc").alias("occurred_at_utc"),
        "arrival_no",
        F.lit(rank).alias("event_rank"),
    )


def reading_events(processed: DataFrame) -> DataFrame:
    """E1 to E4 in one pass: at most one of them applies to a reading."""
    kind = (
        F.when(F.col("outcome") == "Duplicate", DUPLICATE_READING)
        .when(F.col("outcome") == "Conflict", CONFLICTING_READING)
        .when(F.col("sequence_status") == "Gap", SEQUENCE_GAP)
        .when(F.col("sequence_status") == "OutOfOrder", OUT_OF_ORDER_READING)
    )
    found = processed.withColumn("event_type", kind).where(F.col("event_type").isNotNull())
    event, sequence, last = F.col("event_type"), F.col("sequence_number"), F.col("previous_sequence")
    return _shape(
        found.select(
            "event_type",
            F.when(event == CONFLICTING_READING, "Critical").otherwise("Warning").alias("severity"),
            "device_id",
            "acquisition_session_id",
            "sequence_number",
            F.when(event == DUPLICATE_READING, sequence)
            .when(event != CONFLICTING_READING, last)
            .alias("previous_sequence_number"),
            F.when(event == SEQUENCE_GAP, F.col("gap_size")).alias("gap_size"),
            F.when(event == DUPLICATE_READING, DUPLICATE_TEXT)
            .when(event == CONFLICTING_READING, CONFLICT_TEXT)
            .when(event == SEQUENCE_GAP, F.format_string(GAP_TEXT, "gap_size", "previous_sequence"))
            .otherwise(F.format_string(OUT_OF_ORDER_TEXT, "sequence_number", "previous_sequence"))
            .alias("message"),
            "received_at_utc",
            "arrival_no",
        ),
        RANK_READING,
    )


def invalid_message_events(rejected: DataFrame) -> DataFrame:
    """E5: one anonymous event per rejected message."""
    return _shape(
        rejected.select(
            F.lit(INVALID_MESSAGE).alias("event_type"),
            F.lit("Warning").alias("severity"),
            _null("string").alias("device_id"),
            _null("string").alias("acquisition_session_id"),
            _null("bigint").alias("sequence_number"),
            _null("bigint").alias("previous_sequence_number"),
            _null("bigint").alias("gap_size"),
            F.lit(INVALID_TEXT).alias("message"),
            "received_at_utc",
            "arrival_no",
        ),
        RANK_READING,
    )


def concurrent_session_events(conflicts: DataFrame) -> DataFrame:
    """One event per conflict of O7, attributed to the newly observed session."""
    return _shape(
        conflicts.select(
            F.lit(CONCURRENT_SESSIONS).alias("event_type"),
            F.lit("Warning").alias("severity"),
            "device_id",
            F.col("observed_session_id").alias("acquisition_session_id"),
            _null("bigint").alias("sequence_number"),
            _null("bigint").alias("previous_sequence_number"),
            _null("bigint").alias("gap_size"),
            F.format_string(
                CONCURRENT_TEXT,
                F.col("device_id"),
                run_label(F.col("existing_session_id")),
                run_label(F.col("observed_session_id")),
            ).alias("message"),
            "received_at_utc",
            "arrival_no",
        ),
        RANK_CONCURRENT,
    )


def event_stream(processed: DataFrame, rejected: DataFrame, conflicts: DataFrame) -> DataFrame:
    """All events; (arrival_no, event_rank) is their order."""
    return (
        reading_events(processed)
        .unionByName(invalid_message_events(rejected))
        .unionByName(concurrent_session_events(conflicts))
    )


def events_table(stream: DataFrame) -> DataFrame:
    """The stored shape, without the ordering helpers."""
    return stream.select(*EVENT_COLUMNS)
