"""History queries over the readings and events tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellstream.schemas import EVENT_COLUMNS, READING_COLUMNS

# Accepted limits of the query interface.
READINGS_DEFAULT, READINGS_MAX = 100, 1000
EVENTS_DEFAULT, EVENTS_MAX = 20, 100


def check_device(device_id: str) -> None:
    if not device_id or not device_id.strip():
        raise ValueError("device id must not be blank")


def check_limit(limit: int, maximum: int) -> None:
    if not 1 <= limit <= maximum:
        raise ValueError(f"limit must be between 1 and {maximum}")


def reading_response(readings: DataFrame) -> DataFrame:
    """The public columns of a reading."""
    return readings.select(*READING_COLUMNS)


def event_response(events: DataFrame) -> DataFrame:
    """The public columns of an event."""
    return events.select(*EVENT_COLUMNS)


def device_ids(readings: DataFrame) -> DataFrame:
    """H1: devices that have readings, sorted."""
    return readings.select("device_id").distinct().orderBy("device_id")


def latest_sessions(readings: DataFrame) -> DataFrame:
    """H2 for all devices: session of the newest reading; equal times fall to the greater session id."""
    newest = F.struct("timestamp_utc", "received_at_utc", "acquisition_session_id")
    return readings.groupBy("device_id").agg(F.max(newest).alias("_newest")).select(
        "device_id", F.col("_newest.acquisition_session_id").alias("acquisition_session_id")
    )


def latest_session(readings: DataFrame, device_id: str) -> DataFrame:
    """H2 for one device."""
    check_device(device_id)
    return latest_sessions(readings.where(F.col("device_id") == device_id))


def recent_readings(readings: DataFrame, device_id: str, limit: int = READINGS_DEFAULT) -> DataFrame:
    """H3: newest ``limit`` readings of the latest session of one device, oldest first."""
    check_device(device_id)
    check_limit(limit, READINGS_MAX)
    own = readings.where(F.col("device_id") == device_id)
    newest = (
        own.join(latest_sessions(own), ["device_id", "acquisition_session_id"], "left_semi")
        .orderBy(F.desc("timestamp_utc"), F.desc("sequence_number"))
        .limit(limit)
    )
    return reading_response(newest).orderBy("timestamp_utc", "sequence_number")


def recent_readings_per_device(readings: DataFrame, limit: int = READINGS_DEFAULT) -> DataFrame:
    """H3 for every device at once.

    The rank filter is applied before the shuffle as well, so a busy device sends ``limit`` rows per task.
    """
    check_limit(limit, READINGS_MAX)
    own = readings.join(latest_sessions(readings), ["device_id", "acquisition_session_id"], "left_semi")
    newest = Window.partitionBy("device_id").orderBy(F.desc("timestamp_utc"), F.desc("sequence_number"))
    return reading_response(own.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit))


def recent_events(events: DataFrame, limit: int = EVENTS_DEFAULT) -> DataFrame:
    """H4: newest ``limit`` events, newest first."""
    check_limit(limit, EVENTS_MAX)
    return event_response(events).orderBy(F.desc("occurred_at_utc"), F.desc("event_id")).limit(limit)
