"""Concurrent acquisition sessions on one device.

Within the activity window W a session counts as active. A conflict is reported when a reading arrives
while another session of its device is active; once per pair of sessions until one of them was idle for
more than W. Two facts keep the job distributed however busy one device is:

* Only the first reading after a change of session can report something new: later readings of the same
  run see the same other session at a larger distance.
* The rows of a device in order can be cut into slices of bounded size. What a slice passes on is its last
  row, and for each session in it the last time and the activity episode it ended in; an episode is named
  by its first time. These summaries are accumulated over the slices of a device, and rows are only ever
  windowed within a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellstream.operators.ordering import session_pair
from wellstream.operators.slices import SLICE, balanced

DEFAULT_WINDOW_SECONDS = 30
ROWS_PER_SLICE = 1 << 20
_T = "_t"


def _observations(readings: DataFrame, rows_per_slice: int, activity: DataFrame | None = None) -> DataFrame:
    """Readings as observations in slices; the last known observation per session of earlier input comes first."""
    columns = ["received_at_utc", "arrival_no", F.unix_micros("received_at_utc").alias(_T)]
    rows = readings.select(
        "device_id", F.col("acquisition_session_id").alias("session"), *columns,
        F.lit(None).cast("bigint").alias("_known_episode"),
    )
    if activity is not None:
        rows = rows.unionByName(activity.select("device_id", "session", *columns, F.col("episode").alias("_known_episode")))
    # one exchange for all that is windowed or summed within a slice
    return balanced(rows, ["device_id"], _T, "arrival_no", rows_per_slice).repartition("device_id", SLICE)


def _placed(obs: DataFrame, width: int) -> DataFrame:
    """Observations with ``_start``: the first time of their activity episode, null if it began in an earlier slice."""
    own = Window.partitionBy("device_id", SLICE, "session").orderBy(_T, "arrival_no")
    begins = F.coalesce("_known_episode", F.when(F.col(_T) - F.lag(_T).over(own) > width, F.col(_T)))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    return obs.withColumn("_begins", begins).withColumn("_start", F.last("_begins", ignorenulls=True).over(so_far))


def _sessions(placed: DataFrame, width: int) -> DataFrame:
    """(device, session, slice) with its last row, and the episodes in which the session entered and left the slice."""
    per_slice = placed.groupBy("device_id", SLICE, "session").agg(
        F.min(_T).alias("_first_t"), F.max(F.struct(_T, "arrival_no")).alias("_last"), F.max("_start").alias("_start"))
    order = Window.partitionBy("device_id", "session").orderBy(SLICE)
    idle = F.col("_first_t") - F.lag(f"_last.{_T}").over(order)
    fresh = F.when(idle.isNull() | (idle > width), F.col("_first_t"))
    left = per_slice.withColumn("_fresh", fresh).withColumn("_opens", F.coalesce("_start", "_fresh"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    leaving = left.withColumn("episode", F.last("_opens", ignorenulls=True).over(so_far))
    return leaving.select("device_id", "session", SLICE, "_last", "episode", F.coalesce("_fresh", F.lag("episode").over(order)).alias("entered"))


def _changes(placed: DataFrame, width: int) -> DataFrame:
    """First reading after each change of session on a device that follows within the activity window."""
    row = F.struct(_T, "arrival_no", "session", "_start", F.col(SLICE).alias("slice"))
    last_rows = placed.groupBy("device_id", SLICE).agg(F.max(row).alias("_last"))
    earlier = Window.partitionBy("device_id").orderBy(SLICE)
    carried = last_rows.select("device_id", SLICE, F.lag("_last").over(earlier).alias("_carried"))
    order = Window.partitionBy("device_id", SLICE).orderBy(_T, "arrival_no")
    within = placed.withColumn("_previous", F.lag(row).over(order))
    # the first row of a slice has none there
    firsts = within.where("_previous is null").drop("_previous").join(carried, ["device_id", SLICE]).withColumnRenamed("_carried", "_previous")
    rows = within.where("_previous is not null").unionByName(firsts.select(*within.columns))
    return (
        rows.where(F.col("_known_episode").isNull())
        .where(F.col("_previous.session") != F.col("session"))
        .where(F.col(_T) - F.col(f"_previous.{_T}") <= width)
        .select(
            "device_id", SLICE, "session", "received_at_utc", "arrival_no", _T, "_start",
            F.col("_previous.session").alias("other_session"),
            F.col("_previous.slice").alias("_other_slice"),
            F.col("_previous._start").alias("_other_start"),
        )
    )


REPORT_KEY = ["device_id", "first_session", "second_session", "first_episode", "second_episode"]


def keyed_conflicts(
    readings: DataFrame,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    activity: DataFrame | None = None,
    reported: DataFrame | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Conflicts with the key under which each was reported.

    ``activity`` (:func:`latest_activity`) and ``reported`` (keys) continue from earlier input, which must
    have been received before ``readings``.
    """
    width = window_seconds * 1_000_000
    placed = _placed(_observations(readings, rows_per_slice, activity), width)
    entered = _sessions(placed, width).select("device_id", "session", SLICE, "entered")
    other = entered.select(
        "device_id", F.col("session").alias("other_session"), F.col(SLICE).alias("_other_slice"), F.col("entered").alias("_other_entered"))
    changes = _changes(placed, width).join(entered, ["device_id", "session", SLICE]).join(other, ["device_id", "other_session", "_other_slice"])
    episode, other_episode = F.coalesce("_start", "entered"), F.coalesce("_other_start", "_other_entered")
    pair = session_pair(F.col("session"), F.col("other_session"))
    own_first = F.col("session") < F.col("other_session")
    keyed = changes.select(
        "device_id",
        pair["first"].alias("first_session"),
        pair["second"].alias("second_session"),
        F.when(own_first, episode).otherwise(other_episode).alias("first_episode"),
        F.when(own_first, other_episode).otherwise(episode).alias("second_episode"),
        F.struct(_T, "arrival_no", "received_at_utc", "session", "other_session").alias("_c"),
    )
    if reported is not None:
        keyed = keyed.join(reported.select(*REPORT_KEY), REPORT_KEY, "left_anti")
    first = keyed.groupBy(*REPORT_KEY).agg(F.min("_c").alias("_c"))
    return first.select(
        *REPORT_KEY,
        F.col("_c.other_session").alias("existing_session_id"),
        F.col("_c.session").alias("observed_session_id"),
        F.col("_c.arrival_no").alias("arrival_no"),
        F.col("_c.received_at_utc").alias("received_at_utc"),
    )


def latest_activity(
    readings: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS, activity: DataFrame | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Last observation and activity episode per device and session; one row per session, ever seen."""
    width = window_seconds * 1_000_000
    found = _sessions(_placed(_observations(readings, rows_per_slice, activity), width), width)
    last = found.groupBy("device_id", "session").agg(F.max(F.struct(SLICE, "_last", "episode")).alias("_l"))
    return last.select(
        "device_id",
        "session",
        F.timestamp_micros(f"_l._last.{_T}").alias("received_at_utc"),
        F.col("_l._last.arrival_no").alias("arrival_no"),
        F.col("_l.episode").alias("episode"),
    )


def session_conflicts(
    readings: DataFrame, window_seconds: int = DEFAULT_WINDOW_SECONDS, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """One row per reported conflict, at the arrival that revealed it.

    ``readings`` are Stored readings; time is ``received_at_utc`` with ``arrival_no`` as tie-break.
    """
    return keyed_conflicts(readings, window_seconds, rows_per_slice=rows_per_slice).select(
        "device_id", "existing_session_id", "observed_session_id", "arrival_no", "received_at_utc"
    )
