"""Fixed schemas, column groups and contract values. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STREAM_KEY = ["device_id", "acquisition_session_id"]
NATURAL_KEY = [*STREAM_KEY, "sequence_number"]

READING_FIELDS = [
    # (JSON member, column, type)
    ("DeviceId", "device_id", T.StringType()),
    ("AcquisitionSessionId", "acquisition_session_id", T.StringType()),
    ("SequenceNumber", "sequence_number", T.LongType()),
    ("WellId", "well_id", T.StringType()),
    ("WellName", "well_name", T.StringType()),
    ("WellboreId", "wellbore_id", T.StringType()),
    ("WellboreName", "wellbore_name", T.StringType()),
    ("MeasuredDepthMetres", "measured_depth_metres", T.DoubleType()),
    ("DrillingOperation", "drilling_operation", T.StringType()),
    ("DepthChangeRateMetresPerHour", "depth_change_rate_metres_per_hour", T.DoubleType()),
    ("PressurePsi", "pressure_psi", T.DoubleType()),
    ("TemperatureCelsius", "temperature_celsius", T.DoubleType()),
    ("GammaRayApi", "gamma_ray_api", T.DoubleType()),
    ("TimestampUtc", "timestamp_utc", T.TimestampType()),
    ("AcquisitionMode", "acquisition_mode", T.StringType()),
]
READING_COLUMNS = [column for _, column, _ in READING_FIELDS]
# What a redelivered reading may differ in; the natural key is equal by definition.
CONTENT_COLUMNS = [c for c in READING_COLUMNS if c not in NATURAL_KEY]

ARRIVAL_COLUMNS = ["received_at_utc", "arrival_no"]

READING_SCHEMA = T.StructType(
    [T.StructField(column, kind) for _, column, kind in READING_FIELDS]
    + [T.StructField("received_at_utc", T.TimestampType()), T.StructField("arrival_no", T.LongType())]
)

CORRUPT = "_corrupt_record"
MESSAGE_SCHEMA = T.StructType(
    [T.StructField(member, kind) for member, _, kind in READING_FIELDS]
    + [T.StructField(CORRUPT, T.StringType())]
)

RAW_MESSAGE_SCHEMA = T.StructType([
    T.StructField("arrival_no", T.LongType()),
    T.StructField("received_at_utc", T.TimestampType()),
    T.StructField("value", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("acquisition_session_id", T.StringType()),
    T.StructField("sequence_number", T.LongType()),
    T.StructField("previous_sequence_number", T.LongType()),
    T.StructField("gap_size", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("occurred_at_utc", T.TimestampType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# Fixed value: the namespace of the supported log format.
LOG_NAMESPACE = "http://www.witsml.org/schemas/1series"

LOG_HEADER_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("malformed", T.BooleanType()),
    T.StructField("xmlns", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("log_count", T.IntegerType()),
    *[T.StructField(c, T.StringType()) for c in (
        "uid_well", "name_well", "uid_wellbore", "name_wellbore", "uid", "name", "index_type", "index_curve")],
    T.StructField("curves", T.ArrayType(T.StructType([
        T.StructField("mnemonic", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("null_value", T.StringType()),
    ]))),
    T.StructField("has_log_data", T.BooleanType()),
    T.StructField("mnemonic_list", T.StringType()),
    T.StructField("unit_list", T.StringType()),
    # The first data block: runs of plain lines by (block, run), or a line; ``before`` counts the lines ahead of it.
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("run", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("line", T.StringType()),
    ]))),
])

# Fixed values of the data contract.
OPERATIONS = ["Stationary", "DrillingAhead", "TrippingOut"]
MODES = ["RealTime", "HistoricalImport"]
DEFAULT_MODE = "RealTime"
EMPTY_SESSION = "00000000-0000-0000-0000-000000000000"

STORED, DUPLICATE, CONFLICT = "Stored", "Duplicate", "Conflict"
BASELINE, IN_ORDER, GAP, OUT_OF_ORDER = "Baseline", "InOrder", "Gap", "OutOfOrder"
PUBLISHED, LATE_ARRIVAL = "Published", "LateArrival"
