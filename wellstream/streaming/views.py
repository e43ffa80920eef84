"""D3 and D5 over successive refreshes, as keyed state per device.

Each batch is one refresh of the devices that it has readings of. State is what the next refresh needs and no more: the session
shown last, the newest reading of each session that can still be chosen, and the newest readings of the device, at most as many
as the live buffer shows. A refresh costs the readings of its devices, whatever they sent before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wellstream.operators.views import BUFFERED, INACTIVITY_MS

REFRESH_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("active_session_id", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("acquisition_session_id", T.StringType()),
    T.StructField("sequence_number", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("arrival_no", T.LongType()),
])
_ROW = ["timestamp_ms", "sequence_number", "acquisition_session_id", "arrival_no"]


class Refreshes(StatefulProcessor):
    """The live buffer of each refreshed device, newest first, with the session to show."""

    def __init__(self, buffered: int = BUFFERED):
        self._buffered = buffered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pinned, newest, buffer = json.loads(self._state.get()[0]) if self._state.exists() else (None, {}, [])
        frame = pd.DataFrame(buffer, columns=_ROW)
        for chunk in rows:
            # the last arrival of a natural key stands for it; time, then sequence, then session decide
            both = pd.concat([frame, chunk[_ROW]], ignore_index=True).sort_values("arrival_no", kind="stable")
            both = both.drop_duplicates(["acquisition_session_id", "sequence_number"], keep="last")
            for session, ms in chunk.groupby("acquisition_session_id")["timestamp_ms"].max().items():
                newest[session] = max(newest.get(session, -(1 << 62)), int(ms))
            frame = both.sort_values(_ROW[:3], ascending=False, kind="stable").head(self._buffered)
        top = frame.iloc[0]
        latest = max(newest.values())
        # a session that fell silent can't be shown again before it sends
        newest = {s: ms for s, ms in newest.items() if latest - ms <= INACTIVITY_MS}
        active = pinned if pinned in newest else str(top["acquisition_session_id"])
        self._state.update((json.dumps([active, newest, [[int(r[0]), int(r[1]), r[2], int(r[3])] for r in frame.itertuples(index=False)]]),))
        out = frame.assign(device_id=key[0], active_session_id=active, position=range(len(frame)))
        yield out[REFRESH_SCHEMA.fieldNames()].reset_index(drop=True)

    def close(self) -> None:
        pass


def refreshes(readings: DataFrame, buffered: int = BUFFERED) -> DataFrame:
    """One block of rows for each device and batch: (device_id, active_session_id, position in the live buffer, reading)."""
    rows = readings.select("device_id", "acquisition_session_id", "sequence_number", F.unix_millis("timestamp_utc").alias("timestamp_ms"), "arrival_no")
    return rows.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=Refreshes(buffered), outputStructType=REFRESH_SCHEMA, outputMode="Append", timeMode="None")


__all__ = ["REFRESH_SCHEMA", "Refreshes", "refreshes"]
