"""Text shown to people: run labels, operation and mode names, rates, event titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "—"

# Display texts.
OPERATION_LABELS = {
    "Stationary": "Stationary",
    "DrillingAhead": "Drilling ahead",
    "TrippingOut": "Tripping out",
}
MODE_LABELS = {
    "RealTime": "Real-time",
    "HistoricalImport": "Historical import",
}
ORIGIN_LABELS = {
    "imported": "Imported reading",
    "latest": "Latest reading",
    "live": "Live reading",
    "none": "No data",
}
EVENT_TITLES = {
    "DuplicateReading": "Duplicate reading ignored",
    "ConflictingReading": "Conflicting telemetry detected",
    "SequenceGap": "Sequence gap detected",
    "OutOfOrderReading": "Out-of-order reading received",
    "InvalidMessage": "Invalid message rejected",
    "ConcurrentAcquisitionSessions": "Concurrent acquisition sessions detected",
}
CRITICAL_ICON, OTHER_ICON = "×", "!"


def lookup(key: Column, labels: dict[str, str], default: str | None = None) -> Column:
    found = F.coalesce(*[F.when(key == name, text) for name, text in labels.items()])
    return found if default is None else F.coalesce(found, F.lit(default))


def run_label(session: Column) -> Column:
    """First eight hexadecimal digits of a session id, upper case."""
    return F.upper(F.substring(F.replace(session, F.lit("-")), 1, 8))


def active_run_label(session: Column) -> Column:
    return F.coalesce(run_label(session), F.lit(NONE))


def well_monogram(name: Column) -> Column:
    """Last two letters or digits of a well name, upper case."""
    plain = F.regexp_replace(name, "[^a-zA-Z0-9]", "")
    return F.when(F.coalesce(name, F.lit("")) == "", NONE).otherwise(F.upper(F.right(plain, F.lit(2))))


def operation_label(operation: Column) -> Column:
    return lookup(operation, OPERATION_LABELS, NONE)


def mode_label(mode: Column) -> Column:
    return lookup(mode, MODE_LABELS, MODE_LABELS["RealTime"])


def origin_label(mode: Column, live: bool = False) -> Column:
    """Where the latest reading comes from; ``mode`` is null where there is no reading."""
    shown = ORIGIN_LABELS["live" if live else "latest"]
    return (
        F.when(mode.isNull(), ORIGIN_LABELS["none"])
        .when(mode == "HistoricalImport", ORIGIN_LABELS["imported"])
        .otherwise(shown)
    )


def rate_label(rate: Column) -> Column:
    """One decimal, halves away from zero, thousands grouped, plus sign when positive; what rounds to zero keeps a minus."""
    text = F.format_number(F.round(rate, 1), 1)
    text = F.when(rate.cast("string").startswith("-") & (F.round(rate, 1) == 0), F.lit("-0.0")).otherwise(text)
    return F.when(rate > 0, F.concat(F.lit("+"), text)).otherwise(text)


def event_title(event_type: Column) -> Column:
    return lookup(event_type, EVENT_TITLES)


def event_description(event_type: Column, device: Column, sequence: Column, message: Column) -> Column:
    """Device and sequence before the message; absent parts are left out."""
    full = F.concat_ws(" · ", device, F.concat(F.lit("sequence "), sequence.cast("string")), message)
    return F.when(event_type == "ConcurrentAcquisitionSessions", message).otherwise(full)


def event_icon(severity: Column) -> Column:
    return F.when(severity == "Critical", CRITICAL_ICON).otherwise(OTHER_ICON)
