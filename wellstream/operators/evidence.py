"""Recovery-evidence queries (Q1 to Q5) over the readings and events tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _since(column: str, since: datetime | str) -> Column:
    return F.col(column) >= F.lit(since).cast("timestamp")


def sessions_since(readings: DataFrame, since: datetime | str) -> DataFrame:
    """Sessions with their last receipt since ``since``."""
    return (
        readings.where(_since("received_at_utc", since))
        .groupBy("acquisition_session_id")
        .agg(F.max("received_at_utc").alias("finished_at"))
    )


def latest_session_since(readings: DataFrame, since: datetime | str) -> DataFrame:
    """Q1: the session that received a reading last."""
    newest = sessions_since(readings, since).orderBy(F.desc("finished_at"), "acquisition_session_id").limit(1)
    return newest.select("acquisition_session_id")


def session_throughput(readings: DataFrame, since: datetime | str) -> DataFrame:
    """Q2 for every session: readings, devices and average rate between first and last receipt."""
    micros = F.unix_micros("finished_at") - F.unix_micros("started_at")
    return (
        readings.where(_since("received_at_utc", since))
        .groupBy("acquisition_session_id", "device_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("received_at_utc").alias("_first"),
            F.max("received_at_utc").alias("_last"),
        )
        .groupBy("acquisition_session_id")
        .agg(
            F.sum("_n").alias("reading_count"),
            F.count(F.lit(1)).alias("device_count"),
            F.min("_first").alias("started_at"),
            F.max("_last").alias("finished_at"),
        )
        .select(
            "acquisition_session_id",
            "reading_count",
            "device_count",
            F.round(F.col("reading_count") / F.nullif(micros / 1_000_000, F.lit(0.0)), 2)
            .alias("average_readings_per_second"),
            "started_at",
            "finished_at",
        )
    )


def latest_session_throughput(readings: DataFrame, since: datetime | str) -> DataFrame:
    """Q2: the same for the session that received a reading last."""
    return session_throughput(readings, since).orderBy(F.desc("finished_at"), "acquisition_session_id").limit(1)


def sequence_continuity(readings: DataFrame, session: DataFrame) -> DataFrame:
    """Q3: first and last sequence per device of the given sessions and how many are missing between.

    ``session`` is the one row of Q1; readings of other sessions are dropped before the shuffle.
    """
    return (
        readings.join(F.broadcast(session.limit(1)), "acquisition_session_id")
        .groupBy("device_id")
        .agg(
            F.min("sequence_number").alias("minimum_sequence"),
            F.max("sequence_number").alias("maximum_sequence"),
            F.count(F.lit(1)).alias("reading_count"),
        )
        .withColumn(
            "missing_sequences",
            F.col("maximum_sequence") - F.col("minimum_sequence") + 1 - F.col("reading_count"),
        )
    )


def event_counts(events: DataFrame, since: datetime | str) -> DataFrame:
    """Q4: events per type."""
    return (
        events.where(_since("occurred_at_utc", since))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy("event_type")
    )


def order_event_counts(events: DataFrame, since: datetime | str) -> DataFrame:
    """Q5: gap and late events in one row."""
    return events.where(_since("occurred_at_utc", since)).agg(
        F.count_if(F.col("event_type") == "SequenceGap").alias("sequence_gap_events"),
        F.count_if(F.col("event_type") == "OutOfOrderReading").alias("out_of_order_events"),
    )
