"""JSON messages to typed readings, validation and the split into readings and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellstream.functions import predicates as P
from wellstream.functions.once import evaluated_once
from wellstream.schemas import (
    ARRIVAL_COLUMNS, CORRUPT, DEFAULT_MODE, EMPTY_SESSION, MESSAGE_SCHEMA, MODES, OPERATIONS, READING_COLUMNS,
    READING_FIELDS,
)

# Shapes a JSON string must have to become a session id or a timestamp.
GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,16})?)?(Z|[+-]\d{2}:\d{2})?)?$"

EARLIEST = "0001-01-01 00:00:00"

# Members that a writer may leave out, and the value they then have (V4).
DEFAULTS = {
    "acquisition_session_id": EMPTY_SESSION,
    "drilling_operation": OPERATIONS[0],
    "acquisition_mode": DEFAULT_MODE,
}


def _default(column: str, kind: T.DataType) -> Column:
    if column in DEFAULTS:
        return F.lit(DEFAULTS[column])
    if isinstance(kind, T.TimestampType):
        return F.lit(EARLIEST).cast("timestamp")
    return F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)


def _named(value: Column, names: list[str]) -> Column:
    """Enum member by name in any case or by number; anything else stays as it is and fails its rule later."""
    text = F.lower(F.trim(value))
    match = F.coalesce(*[F.when((text == name.lower()) | (text == str(i)), name) for i, name in enumerate(names)])
    return F.coalesce(match, value)


# JSON types, as the schema of a variant names them, that a column accepts.
JSON_TYPES = {
    "string": ["STRING"],
    "timestamp": ["STRING"],
    "bigint": ["BIGINT"],
    "double": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"],
}
# Members of an enumeration, which may come as a number too.
ENUM_MEMBERS = ["DrillingOperation", "AcquisitionMode"]
# How the value of a member of that type cannot start; a quick look before the exact check.
UNUSUAL_START = {
    "string": r'[^"\s]',
    "timestamp": r'[^"\s]',
    "bigint": r"(?:[^\d\s-]|-?\d+[.eE])",
    "double": r"[^\d\s-]",
}


# What an ordinary value of that type looks like; a text in which nothing is escaped.
ORDINARY = {
    "string": r'"[^"\\\x00-\x1F]*+"',
    "timestamp": r'"[^"\\\x00-\x1F]*+"',
    "bigint": r"-?(?:0|[1-9]\d*+)",
    "double": r"-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?",
}


def _ordinary() -> Column:
    """True where the text is one object of known members, each with an ordinary value of its type, and nothing else.

    One pass over the text from its start tells that neither ``_wrong_type`` nor ``_one_value`` can object. Any other
    text, an object of more than 32 members too, is left to them.
    """
    by_value: dict[str, list[str]] = {}
    for member, _, kind in READING_FIELDS:
        by_value.setdefault(ORDINARY[kind.simpleString()], []).append(member)
    member = "|".join(rf'(?:{"|".join(ms)})":\x20?{value}' for value, ms in by_value.items())
    return F.coalesce(F.col("value").rlike(rf'\A\{{(?:"(?:{member})(?:,\x20?(?=")|(?=\}}))){{1,32}}\}}\z'), F.lit(False))


def _wrong_type() -> Column:
    """True where a member of the message has another JSON type than its column, null included.

    Messages are well-typed almost always, so a pattern over the text sorts out the rare suspects (an
    escaped member name makes one too) and only they are parsed a second time and looked at by member.
    """
    by_start: dict[str, list[str]] = {}
    for member, _, kind in READING_FIELDS:
        by_start.setdefault(UNUSUAL_START[kind.simpleString()], []).append(member)
    pattern = '"(?:' + "|".join(rf'(?:{"|".join(ms)})"\s*:\s*{start}' for start, ms in by_start.items()) + ")"
    suspect = F.col("value").rlike(pattern) | F.contains("value", F.lit("\\u"))
    accepted = F.create_map(*[
        F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x))
        for member, _, kind in READING_FIELDS
        for x in (member, JSON_TYPES[kind.simpleString()] + (["BIGINT"] if member in ENUM_MEMBERS else []))
    ])
    members = F.map_entries(F.try_parse_json("value").cast("map<string,variant>"))
    wrong = F.exists(members, lambda e: F.coalesce(
        ~F.array_contains(
            F.try_element_at(accepted, e["key"]), F.regexp_extract(F.schema_of_variant(e["value"]), "^[A-Z]+", 0)
        ),
        F.lit(False),
    ))
    return F.when(suspect, F.coalesce(wrong, F.lit(True))).otherwise(F.lit(False))


def _one_value() -> Column:
    """True unless something follows the object: the JSON reader stops at its end and drops the rest.

    If the only closing brace ends the text, nothing follows. Other texts are read as the first of two list
    elements, the second being a hash of the text: more or fewer elements betray what follows.
    """
    text = F.rtrim(F.col("value"))
    mark = F.xxhash64("value").cast("string")
    listed = F.from_json(F.concat(F.lit("["), "value", F.lit(","), mark, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    exact = F.coalesce((F.size(listed) == 2) & (F.try_element_at(listed, F.lit(-1)) == mark), F.lit(False))
    return (F.locate("}", F.col("value")) == F.char_length(text)) | exact


def parse_messages(messages: DataFrame, strict: bool = True) -> DataFrame:
    """Messages (value, arrival_no, received_at_utc) to reading columns; ``parsed`` tells success.

    Absent members take their defaults. ``strict`` also rejects what the JSON reader of Spark lets pass: a
    number where a string belongs, an explicit null, text after the object. Works the same on batch and streaming input.
    """
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "false",
        "allowSingleQuotes": "false",
    }
    # Timestamps are read as text first: only ISO text counts, and 100 ns digits are cut to micros.
    text_schema = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
        for f in MESSAGE_SCHEMA
    ])
    read = evaluated_once(messages.select(*ARRIVAL_COLUMNS, "value"), _m=F.from_json("value", text_schema, options))
    ok = F.col("_m").isNotNull() & F.col(f"_m.{CORRUPT}").isNull()
    if strict:
        ok = ok & (_ordinary() | (~_wrong_type() & _one_value()))
    session, time = F.col("_m.AcquisitionSessionId"), F.col("_m.TimestampUtc")
    instant = F.try_to_timestamp(F.when(time.rlike(ISO_TIME), time))
    ok = ok & (session.isNull() | session.rlike(GUID)) & (time.isNull() | instant.isNotNull())

    def typed(member: str, column: str, kind: T.DataType) -> Column:
        value = F.col(f"_m.{member}")
        if isinstance(kind, T.TimestampType):
            value = instant
        elif column == "acquisition_session_id":
            value = F.lower(value)
        elif column == "drilling_operation":
            value = _named(value, OPERATIONS)
        elif column == "acquisition_mode":
            value = _named(value, MODES)
        return F.coalesce(value, _default(column, kind))

    columns = {column: typed(member, column, kind) for member, column, kind in READING_FIELDS}
    return evaluated_once(read, **columns, parsed=ok).select(*READING_COLUMNS, *ARRIVAL_COLUMNS, "value", "parsed")


def validate(readings: DataFrame) -> DataFrame:
    """V1: adds ``reject_reason``, the first broken rule or null. ``parsed`` is honoured if present."""
    reason = P.reject_reason()
    if "parsed" in readings.columns:
        reason = F.when(~F.col("parsed"), P.BAD_JSON).otherwise(reason)
    return readings.withColumn("reject_reason", reason)


def valid_readings(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).select(*READING_COLUMNS, *ARRIVAL_COLUMNS)


def rejects(validated: DataFrame) -> DataFrame:
    """What leaves the main flow, with the raw message where there is one."""
    raw = ["value"] if "value" in validated.columns else []
    return validated.where(F.col("reject_reason").isNotNull()).select(*ARRIVAL_COLUMNS, *raw, "reject_reason")
