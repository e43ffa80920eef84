"""O2, O4 and O7 as keyed state (transformWithStateInPandas), for jobs that keep no readings table.

State lives in the RocksDB provider (``session.STATE_STORE_CONF``). The rows of a key reach Python as Arrow batches of the
few numbers that decide, and are worked on as arrays: a batch costs what its own keys and rows need. Each key has one
value, read once and written once per batch.

Keys are kept for ever, as the definitions ask, but for two cases: ``ttl_ms`` bounds the state of O2 at the price that a
copy arriving after that time counts as new, and O7 drops sessions that were idle for longer than the activity window,
which can't matter any more; a timer drops those of devices that fell silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wellstream.schemas import (
    BASELINE, CONFLICT, CONTENT_COLUMNS, DUPLICATE, GAP, IN_ORDER, OUT_OF_ORDER, READING_SCHEMA, STORED, STREAM_KEY,
)

COPY_SCHEMA = T.StructType([T.StructField("arrival_no", T.LongType()), T.StructField("store_status", T.StringType())])
SEQUENCE_SCHEMA = T.StructType([
    T.StructField("arrival_no", T.LongType()),
    T.StructField("previous_sequence", T.LongType()),
    T.StructField("sequence_status", T.StringType()),
    T.StructField("gap_size", T.LongType()),
])
CONFLICT_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("existing_session_id", T.StringType()),
    T.StructField("observed_session_id", T.StringType()),
    T.StructField("arrival_no", T.LongType()),
    T.StructField("received_at_utc", T.TimestampType()),
])
#: Sequence numbers that share one value of state: a stream is cut into blocks of so many, so a busy one is many keys.
SEQUENCES_PER_BLOCK = 1024
_FIRST = np.dtype([("sequence", "<i8"), ("a", "<i8"), ("b", "<i8")])


def content_hashes() -> list[Column]:
    """Two hashes of all that copies are compared by; null differs from every value, and negative zero is zero."""
    kinds = {f.name: f.dataType for f in READING_SCHEMA}

    def value(name: str) -> Column:
        if isinstance(kinds[name], T.TimestampType):
            return F.unix_micros(name)
        return F.col(name) + F.lit(0.0) if isinstance(kinds[name], T.DoubleType) else F.col(name)

    text = F.to_json(F.struct(*[value(c).alias(c) for c in CONTENT_COLUMNS]))
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")]


def _all(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """The rows of a key in order; they are numbers, so those of the busiest key of a batch fit a task."""
    return pd.concat(list(rows), ignore_index=True).sort_values([*order], kind="stable", ignore_index=True)


class Copies(StatefulProcessor):
    """O2 per block of a stream. State: sequence number and content hashes of each first arrival, by sequence number."""

    def __init__(self, ttl_ms: int | None = None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first", "data binary", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _all(rows, "sequence_number", "arrival_no")
        known = np.frombuffer(self._first.get()[0], dtype=_FIRST) if self._first.exists() else np.empty(0, dtype=_FIRST)
        sequence = frame["sequence_number"].to_numpy()
        opens = np.append(True, sequence[1:] != sequence[:-1])
        own = np.rec.fromarrays([sequence, frame["a"].to_numpy(), frame["b"].to_numpy()], dtype=_FIRST)
        new = opens & ~np.isin(sequence, known["sequence"])
        merged = np.concatenate((known, own[new]))
        merged = merged[np.argsort(merged["sequence"], kind="stable")]
        first = merged[np.searchsorted(merged["sequence"], sequence)]
        equal = (first["a"] == own["a"]) & (first["b"] == own["b"])
        if new.any():
            self._first.update((merged.tobytes(),))
        status = np.select([new, equal], [STORED, DUPLICATE], CONFLICT)
        yield pd.DataFrame({"arrival_no": frame["arrival_no"], "store_status": status})

    def close(self) -> None:
        pass


class Sequences(StatefulProcessor):
    """O4 per stream. State: the highest sequence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _all(rows, "arrival_no")
        sequence = frame["sequence_number"].to_numpy()
        before = self._last.get()[0] if self._last.exists() else None
        running = np.maximum.accumulate(sequence if before is None else np.append(before, sequence))
        last = np.append(0, running[:-1]) if before is None else running[:-1]
        ahead = sequence - last
        first = np.zeros(len(sequence), dtype=bool)
        first[0] = before is None
        status = np.select([first, ahead == 0, ahead < 0, ahead == 1], [BASELINE, DUPLICATE, OUT_OF_ORDER, IN_ORDER], GAP)
        self._last.update((int(running[-1]),))
        yield pd.DataFrame({
            "arrival_no": frame["arrival_no"],
            "previous_sequence": pd.Series(last, dtype="Int64").mask(first),
            "sequence_status": status,
            "gap_size": pd.Series(ahead - 1, dtype="Int64").where(status == GAP),
        })

    def close(self) -> None:
        pass


class Conflicts(StatefulProcessor):
    """O7 per device, after the same facts as the batch operator.

    State: the newest observation, time and activity episode of each active session, and the episodes under which each pair
    of them was last reported. An episode is named by its first time, in microseconds. Only runs of rows of one session
    are looked at one by one; a run also ends where the session was idle.
    """

    def __init__(self, window_seconds: int):
        self._width = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "state string")

    def _read(self) -> tuple[str | None, dict[str, list[int]], dict[tuple[str, str], list[int]]]:
        if not self._state.exists():
            return None, {}, {}
        newest, sessions, reports = json.loads(self._state.get()[0])
        return newest, sessions, {(a, b): episodes for a, b, episodes in reports}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _all(rows, "t", "arrival_no")
        newest, sessions, reports = self._read()
        times, names = frame["t"].to_numpy(), frame["acquisition_session_id"].to_numpy()
        starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (np.diff(times) > self._width)))
        ends = np.append(starts[1:], len(frame)) - 1
        found = []
        for i, end in zip(starts, ends, strict=True):
            own, t = names[i], int(times[i])
            last, episode = sessions.get(own, (None, t))
            if last is None or t - last > self._width:
                episode = t
            other = sessions.get(newest) if newest is not None and newest != own else None
            if other is not None and t - other[0] <= self._width:
                pair = sorted([(own, episode), (newest, other[1])])
                key_of, episodes = (pair[0][0], pair[1][0]), [pair[0][1], pair[1][1]]
                if reports.get(key_of) != episodes:
                    reports[key_of] = episodes
                    found.append((newest, own, i))
            sessions[own], newest = [int(times[end]), episode], own
        live = {s: v for s, v in sessions.items() if sessions[newest][0] - v[0] <= self._width}
        kept = [(a, b, e) for (a, b), e in reports.items() if a in live and b in live and [live[a][1], live[b][1]] == e]
        self._state.update((json.dumps([newest, live, kept]),))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(sessions[newest][0] // 1000 + self._width // 1000 + 1)
        if found:
            place = [i for _, _, i in found]
            yield pd.DataFrame({
                "device_id": key[0],
                "existing_session_id": [e for e, _, _ in found],
                "observed_session_id": [o for _, o, _ in found],
                "arrival_no": frame["arrival_no"].to_numpy()[place],
                "received_at_utc": pd.to_datetime(times[place], unit="us"),
            })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No reading can meet these sessions any more: the watermark has passed their activity window."""
        self._state.clear()
        return iter([])

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType, time: str = "None") -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time)


def classify_copies_stream(readings: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(arrival_no, store_status) of a stream of valid readings."""
    block = F.floor(F.col("sequence_number") / SEQUENCES_PER_BLOCK).cast("bigint").alias("block")
    rows = readings.select(*STREAM_KEY, block, "sequence_number", "arrival_no", *content_hashes())
    return _keyed(rows, [*STREAM_KEY, "block"], Copies(ttl_ms), COPY_SCHEMA, "None" if ttl_ms is None else "ProcessingTime")


def classify_sequence_stream(readings: DataFrame) -> DataFrame:
    """(arrival_no, previous_sequence, sequence_status, gap_size) of a stream of readings."""
    return _keyed(readings.select(*STREAM_KEY, "sequence_number", "arrival_no"), STREAM_KEY, Sequences(), SEQUENCE_SCHEMA)


def session_conflicts_stream(readings: DataFrame, window_seconds: int) -> DataFrame:
    """Conflicts of a stream of Stored readings that comes in the order of receipt.

    A reading that is received more than an activity window before the newest one of an earlier batch is dropped.
    """
    timed = readings.withWatermark("received_at_utc", f"{window_seconds} seconds")
    rows = timed.select("device_id", "acquisition_session_id", "arrival_no", "received_at_utc", F.unix_micros("received_at_utc").alias("t"))
    return _keyed(rows, ["device_id"], Conflicts(window_seconds), CONFLICT_SCHEMA, "EventTime")
