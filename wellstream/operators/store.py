"""Insert-if-absent of arriving readings against a table that already holds some (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellstream.operators.ordering import classify_copies, same_content
from wellstream.schemas import CONFLICT, CONTENT_COLUMNS, DUPLICATE, NATURAL_KEY, STORED


def classify_against(
    stored: DataFrame, incoming: DataFrame, arrivals: DataFrame | None = None, maybe_stored: DataFrame | None = None
) -> DataFrame:
    """``store_status`` of incoming readings: compared with the stored content where the key exists there,
    otherwise with the first incoming arrival of the key.

    The table is reduced to the incoming keys first, so that only their rows are ever shuffled when the
    keys fit a broadcast. ``maybe_stored`` narrows the keys that can exist in the table at all.
    """
    keys = (incoming if maybe_stored is None else maybe_stored).select(*NATURAL_KEY).distinct()
    known = stored.join(keys, NATURAL_KEY, "left_semi").select(
        *NATURAL_KEY, F.struct(*CONTENT_COLUMNS).alias("_known")
    )
    among_incoming = F.col("store_status")
    status = (
        F.when(F.col("_known").isNull(), among_incoming)
        .when(same_content(F.col("_known")), DUPLICATE)
        .otherwise(CONFLICT)
    )
    matched = classify_copies(incoming, arrivals).join(known, NATURAL_KEY, "left")
    return matched.select(*incoming.columns, status.alias("store_status"))


def insert_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Events to append: each event_id once, unless the table holds it.

    An event_id follows from what happened, so copies of one id are equal rows and any of them may stay.
    """
    return incoming.join(stored.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])


def insert_if_absent(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: first arrivals of keys that the table does not hold."""
    fresh = classify_against(stored, incoming).where(F.col("store_status") == STORED)
    return fresh.select(*incoming.columns)
