"""Chart-ready batch views (D1 to D14), for all devices at once.

Times compare at millisecond precision. Ties fall to the greater sequence, then to the greater session id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.functions import labels as L
from wellstream.schemas import EVENT_COLUMNS, NATURAL_KEY, READING_COLUMNS

# Sizes and thresholds of the views.
DISPLAYED, BUFFERED, EVENTS_KEPT, EVENTS_VISIBLE = 100, 200, 20, 4
INACTIVITY_MS = 30_000
AXIS_SHARE, DEPTH_PADDING, GAMMA_PADDING = 0.08, 0.05, 1.0


def _ms() -> Column:
    return F.unix_millis("timestamp_utc")


def _recency() -> Column:
    return F.struct(_ms().alias("ms"), F.col("sequence_number"), F.col("acquisition_session_id"))


def merge_readings(baseline: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by natural key; incoming wins, then the later arrival. Combines before the shuffle."""
    columns = [*READING_COLUMNS, "received_at_utc", "arrival_no"]
    both = baseline.select(*columns, F.lit(0).alias("_source")).unionByName(
        incoming.select(*columns, F.lit(1).alias("_source"))
    )
    content = F.struct(*[c for c in columns if c not in NATURAL_KEY])
    return (
        both.groupBy(*NATURAL_KEY)
        .agg(F.max_by(content, F.struct("_source", "arrival_no")).alias("_kept"))
        .select(*NATURAL_KEY, "_kept.*")
        .select(*columns)
    )


def active_sessions(readings: DataFrame, pinned: DataFrame) -> DataFrame:
    """Session to show per device. ``pinned`` (device_id, pinned_session_id) is the previous choice.

    The previous session stays unless it has no readings or its newest one is more than 30 s older than
    the newest of the device.
    """
    newest = readings.groupBy("device_id", "acquisition_session_id").agg(F.max(_recency()).alias("_newest"))
    compared = newest.join(pinned, "device_id", "left").groupBy("device_id").agg(
        F.max("_newest").alias("_latest"),
        F.max(F.when(F.col("acquisition_session_id") == F.col("pinned_session_id"), F.col("_newest"))).alias("_pinned"),
    )
    return compared.select(
        "device_id",
        F.when(
            F.col("_pinned").isNull() | (F.col("_latest.ms") - F.col("_pinned.ms") > INACTIVITY_MS),
            F.col("_latest.acquisition_session_id"),
        ).otherwise(F.col("_pinned.acquisition_session_id")).alias("acquisition_session_id"),
    )


def _newest_per_device(readings: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("device_id").orderBy(
        _ms().desc(), F.desc("sequence_number"), F.desc("acquisition_session_id")
    )
    return readings.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count).drop("_rank")


def displayed_readings(merged: DataFrame, active: DataFrame, count: int = DISPLAYED) -> DataFrame:
    """Newest readings of the active session of each device."""
    return _newest_per_device(merged.join(active, ["device_id", "acquisition_session_id"], "left_semi"), count)


def live_buffer(merged: DataFrame, count: int = BUFFERED) -> DataFrame:
    """D3: newest readings of each device, all sessions."""
    return _newest_per_device(merged, count)


def latest_readings(readings: DataFrame) -> DataFrame:
    """Newest reading of each device."""
    return (
        readings.groupBy("device_id")
        .agg(F.max_by(F.struct(*[c for c in READING_COLUMNS if c != "device_id"]), _recency()).alias("_latest"))
        .select("device_id", "_latest.*")
    )


def all_devices(known: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct devices of both inputs, sorted."""
    return known.select("device_id").union(new.select("device_id")).distinct().orderBy("device_id")


def merge_events(baseline: DataFrame, incoming: DataFrame, count: int = EVENTS_KEPT) -> DataFrame:
    """Union by event id, incoming wins; newest ``count``."""
    both = baseline.select(*EVENT_COLUMNS, F.lit(0).alias("_source")).unionByName(
        incoming.select(*EVENT_COLUMNS, F.lit(1).alias("_source"))
    )
    return (
        both.groupBy("event_id")
        .agg(F.max_by(F.struct(*EVENT_COLUMNS[1:]), "_source").alias("_kept"))
        .select("event_id", "_kept.*")
        .orderBy(F.unix_millis("occurred_at_utc").desc(), F.desc("event_id"))
        .limit(count)
    )


def visible_events(merged: DataFrame, count: int = EVENTS_VISIBLE) -> DataFrame:
    """The first few of the merged events."""
    return merged.orderBy(F.unix_millis("occurred_at_utc").desc(), F.desc("event_id")).limit(count)


def _axis(readings: DataFrame, column: str, least: float) -> DataFrame:
    low, high = F.min(column), F.max(column)
    return readings.groupBy("device_id").agg(
        low.alias("_low"), high.alias("_high"), F.greatest((high - low) * AXIS_SHARE, F.lit(least)).alias("_padding")
    )


def depth_axis(readings: DataFrame) -> DataFrame:
    """Depth range with padding on both sides."""
    return _axis(readings, "measured_depth_metres", DEPTH_PADDING).select(
        "device_id",
        (F.col("_low") - F.col("_padding")).alias("axis_min"),
        (F.col("_high") + F.col("_padding")).alias("axis_max"),
    )


def gamma_axis(readings: DataFrame) -> DataFrame:
    """Gamma range with padding, never below zero."""
    return _axis(readings, "gamma_ray_api", GAMMA_PADDING).select(
        "device_id",
        F.greatest(F.lit(0.0), F.col("_low") - F.col("_padding")).alias("axis_min"),
        (F.col("_high") + F.col("_padding")).alias("axis_max"),
    )


def depth_series(readings: DataFrame) -> DataFrame:
    """Depth over time."""
    return readings.select(
        "device_id", "sequence_number", _ms().alias("x"), F.col("measured_depth_metres").alias("y")
    )


def gamma_series(readings: DataFrame) -> DataFrame:
    """Depth over gamma ray."""
    return readings.select(
        "device_id", "sequence_number", F.col("gamma_ray_api").alias("x"), F.col("measured_depth_metres").alias("y")
    )


def pressure_temperature_series(readings: DataFrame) -> DataFrame:
    """Pressure and temperature by time label."""
    return readings.select(
        "device_id", "sequence_number", F.date_format("timestamp_utc", "HH:mm:ss").alias("label"),
        F.col("pressure_psi").alias("pressure"), F.col("temperature_celsius").alias("temperature"),
    )


def status_labels(latest: DataFrame, live: bool = False) -> DataFrame:
    """Labels of the latest reading of each device."""
    return latest.select(
        "device_id",
        L.active_run_label(F.col("acquisition_session_id")).alias("run_label"),
        L.well_monogram(F.col("well_name")).alias("well_monogram"),
        L.operation_label(F.col("drilling_operation")).alias("operation_label"),
        L.mode_label(F.col("acquisition_mode")).alias("acquisition_label"),
        L.origin_label(F.col("acquisition_mode"), live).alias("origin_label"),
        L.rate_label(F.col("depth_change_rate_metres_per_hour")).alias("rate_label"),
    )


def event_cards(events: DataFrame) -> DataFrame:
    """Title, description and icon of events."""
    return events.select(
        "event_id",
        L.event_title(F.col("event_type")).alias("title"),
        L.event_description(
            F.col("event_type"), F.col("device_id"), F.col("sequence_number"), F.col("message")
        ).alias("description"),
        L.event_icon(F.col("severity")).alias("icon"),
    )
