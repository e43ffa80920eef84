"""M4 on a stream: samples of every second, the empty ones too, as keyed state.

Readings are counted per interval behind a watermark, so an interval comes once, complete, and late readings are dropped:
they are in no sample. What is left is one row per interval, whatever the rate; a stateful operator with a single key puts these rows
in order, adds up, carries the last latency and fills the silence between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wellstream.operators.metrics import LONGEST_SILENCE, SECOND, latency_micros

SERIES_SCHEMA = T.StructType([
    T.StructField("sampled_at_utc", T.TimestampType()),
    T.StructField("readings_processed_total", T.LongType()),
    T.StructField("readings_per_second", T.DoubleType()),
    T.StructField("latest_end_to_end_latency_ms", T.DoubleType()),
])


class Samples(StatefulProcessor):
    """State: the last interval with receipts, the readings so far and the last latency."""

    def __init__(self, interval_seconds: int, longest_silence_seconds: int):
        self._step, self._silence, self._seconds = interval_seconds * SECOND, longest_silence_seconds * SECOND, float(interval_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "interval bigint, total bigint, latency bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("interval", ignore_index=True)
        interval, total, latency = self._last.get() if self._last.exists() else (None, 0, None)
        at, n = frame["interval"].to_numpy(), frame["n"].to_numpy()
        totals = total + np.cumsum(n)
        latencies = frame["latency"].astype("Int64").ffill()
        latencies = latencies if latency is None else latencies.fillna(latency)
        # the silence before each interval belongs to what was known ahead of it
        before = np.append(at[0] if interval is None else interval, at[:-1])
        known = np.append(total, totals[:-1])
        empty = np.where(at - before <= self._silence, np.maximum((at - before) // self._step - 1, 0), 0)
        earlier = pd.concat([pd.Series([latency], dtype="Int64"), latencies.iloc[:-1]], ignore_index=True)
        for i in range(len(at)):
            ends = before[i] + (np.arange(1, empty[i] + 1) + 1) * self._step
            times = np.append(ends, at[i] + self._step)
            ms = np.append(np.repeat(np.nan if pd.isna(earlier[i]) else earlier[i] / 1000, empty[i]), np.nan if pd.isna(latencies[i]) else latencies[i] / 1000)
            yield pd.DataFrame({
                "sampled_at_utc": pd.to_datetime(times, unit="us"),
                "readings_processed_total": np.append(np.repeat(known[i], empty[i]), totals[i]),
                "readings_per_second": np.append(np.zeros(empty[i]), n[i] / self._seconds),
                "latest_end_to_end_latency_ms": pd.Series(ms).astype(object).where(~np.isnan(ms), None),
            })
        last = latencies.iloc[-1]
        self._last.update((int(at[-1]), int(totals[-1]), None if pd.isna(last) else int(last)))

    def close(self) -> None:
        pass


def metrics_series_stream(
    published: DataFrame, interval_seconds: int = 1, delay: str = "10 seconds", longest_silence_seconds: int = LONGEST_SILENCE
) -> DataFrame:
    """The samples of :func:`metrics.metrics_series` up to the last interval that the watermark has passed."""
    timed = published.withWatermark("received_at_utc", delay)
    latency = latency_micros()
    newest = F.max(F.when(latency.isNotNull(), F.struct("received_at_utc", "arrival_no", latency.alias("us"))))
    counted = timed.groupBy(F.window("received_at_utc", f"{interval_seconds} seconds")).agg(F.count(F.lit(1)).alias("n"), newest.alias("_newest"))
    rows = counted.select(F.lit(0).alias("series"), F.unix_micros("window.start").alias("interval"), "n", F.col("_newest.us").alias("latency"))
    return rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=Samples(interval_seconds, longest_silence_seconds), outputStructType=SERIES_SCHEMA, outputMode="Append", timeMode="None")
