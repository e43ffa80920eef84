"""Reading tables derived from the ``events`` table; they stand in for an operational feed.

The formulas are deterministic, so that a SQL engine can derive the same rows. Events carry no arrival
order of their own; the derivation adds invalid values, gaps, delays, redeliveries and conflicting copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellstream.operators.slices import SLICE, carried, slice_start, slice_window
from wellstream.schemas import ARRIVAL_COLUMNS, EMPTY_SESSION, READING_COLUMNS, READING_FIELDS, STREAM_KEY

SESSION_A = "11111111-1111-4111-8111-111111111111"
SESSION_B = "22222222-2222-4222-8222-222222222222"

MICROS_PER_HOUR = 3_600_000_000
ROWS_PER_SLICE = 1 << 17


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value"
    )


def device_of(user_id: Column) -> Column:
    """At least three digits; a longer number keeps all of its own (lpad alone would cut it)."""
    digits = user_id.cast("string")
    return F.concat(F.lit("DRILL-"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def numbered_events(
    spark: SparkSession, sf_dir: str, keys: list[str] = STREAM_KEY, slice_micros: int = 6 * MICROS_PER_HOUR,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Events with their stream and ``rn``, the position inside ``keys`` by (ts, event_id).

    Only keys of more than ROWS_PER_SLICE events are cut into slices, by time. These are few; others are one slice.
    Events without a time count as the first ones of their key but are left out.
    """
    events = read_events(spark, sf_dir).select(
        "*",
        device_of(F.col("user_id")).alias("device_id"),
        F.when(F.col("event_id") % 5 < 3, SESSION_A).otherwise(SESSION_B).alias("acquisition_session_id"),
    ).where(F.col("device_id").isNotNull())
    large = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_slice).select(*keys, F.lit(True).alias("_large"))
    sliced = events.join(F.broadcast(large), keys, "left").withColumn(
        SLICE, F.when(F.col("_large"), slice_start(F.unix_micros("ts"), slice_micros)).otherwise(F.lit(0).cast("bigint"))).drop("_large")
    cut = events.join(F.broadcast(large), keys).withColumn(SLICE, slice_start(F.unix_micros("ts"), slice_micros))
    before = carried(cut, keys, {"_before": (F.count(F.lit(1)), "sum")})
    counted = sliced.join(before, [*keys, SLICE], "left")
    local = F.row_number().over(slice_window(keys, "ts", "event_id"))
    return counted.withColumn("rn", (F.coalesce("_before", F.lit(0)) + local).cast("bigint")).drop("_before", SLICE).where("ts is not null")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as they arrive: 15 reading columns, ``received_at_utc`` and the unique ``arrival_no``."""
    e = numbered_events(spark, sf_dir)
    event_id = F.col("event_id")
    well = F.concat(F.lit("WELL-"), (F.col("user_id") % 4).cast("string"))
    kind = event_id % 3
    rate = F.when(kind == 0, 0.0).when(kind == 1, 18.0).otherwise(-18.0)
    base = e.select(
        "event_id",
        "device_id",
        "acquisition_session_id",
        (F.col("rn") + F.floor(F.col("rn") / 10).cast("bigint")).alias("sequence_number"),
        well.alias("well_id"),
        F.concat(F.lit("Well "), (F.col("user_id") % 4).cast("string")).alias("well_name"),
        F.concat(well, F.lit("-MAIN")).alias("wellbore_id"),
        F.lit("Main").alias("wellbore_name"),
        F.when(event_id % 29 == 0, -1.0).otherwise(1000.0 + F.col("rn") * 0.5).alias("measured_depth_metres"),
        F.when(kind == 0, "Stationary").when(kind == 1, "DrillingAhead").otherwise("TrippingOut")
        .alias("drilling_operation"),
        F.when(event_id % 31 == 0, 7.0).otherwise(rate).alias("depth_change_rate_metres_per_hour"),
        (8000.0 + F.col("value")).alias("pressure_psi"),
        (100.0 + (event_id % 40) * 0.5).alias("temperature_celsius"),
        F.col("value").alias("gamma_ray_api"),
        F.col("ts").alias("timestamp_utc"),
        F.when(event_id % 5 < 3, "RealTime").otherwise("HistoricalImport").alias("acquisition_mode"),
        F.timestamp_micros(F.unix_micros("ts") + (event_id % 90 - 5) * 1_000_000).alias("received_at_utc"),
        (event_id * 10 + F.when(event_id % 11 == 0, 5003).otherwise(0)).alias("arrival_no"),
    )
    # Redeliveries: one pass over the rows, each fanned out into its copies.
    copy = F.struct(F.lit(0).alias("gamma"), F.lit(0).alias("delay_s"), F.lit(0).alias("shift"))

    def variant(condition, gamma, shift):
        made = F.struct(F.lit(gamma).alias("gamma"), F.lit(3600).alias("delay_s"), F.lit(shift).alias("shift"))
        return F.when(condition, made)

    copies = F.array_compact(F.array(copy, variant(event_id % 17 == 0, 0, 20001), variant(event_id % 23 == 0, 1, 30002)))
    fanned = base.withColumn("_copy", F.explode(copies))
    return fanned.select(
        *[c for c in READING_COLUMNS if c not in ("gamma_ray_api",)],
        (F.col("gamma_ray_api") + F.col("_copy.gamma")).alias("gamma_ray_api"),
        F.timestamp_micros(F.unix_micros("received_at_utc") + F.col("_copy.delay_s").cast("bigint") * 1_000_000)
        .alias("received_at_utc"),
        (F.col("arrival_no") + F.col("_copy.shift")).alias("arrival_no"),
    ).select(*READING_COLUMNS, *ARRIVAL_COLUMNS)


def session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations (device_id, acquisition_session_id, received_at_utc, arrival_no) seconds apart, of four sessions per device.

    Pauses of more than half a minute come after every ninth reading, and some readings are received at one instant.
    """
    e = numbered_events(spark, sf_dir, ["device_id"])
    rn, event_id = F.col("rn"), F.col("event_id")
    seconds = (rn - F.when(rn % 13 == 0, 1).otherwise(0)) * 11 + F.floor(rn / 9).cast("bigint") * 40 + F.floor(rn / 40).cast("bigint") * 25
    session = F.concat(F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit("-0000-4000-8000-00000000000"), (F.floor(event_id * 7 / 3).cast("bigint") % 4).cast("string"))
    return e.select(
        "device_id", session.alias("acquisition_session_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + seconds * 1_000_000).alias("received_at_utc"), event_id.alias("arrival_no"))


# One broken member per kind of row: every validation rule has rows that break it.
BROKEN = [
    ("device_id", " "), ("device_id", None), ("acquisition_session_id", EMPTY_SESSION), ("acquisition_session_id", ""),
    ("sequence_number", 0), ("sequence_number", -5), ("well_id", ""), ("well_name", " "), ("wellbore_id", "\t"),
    ("wellbore_name", None), ("measured_depth_metres", float("nan")), ("measured_depth_metres", float("inf")),
    ("drilling_operation", "Sideways"), ("depth_change_rate_metres_per_hour", float("nan")), ("gamma_ray_api", -1.0),
    ("gamma_ray_api", float("nan")), ("acquisition_mode", "Sometimes"),
]
KINDS = 41


def broken_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arrivals`` of which 17 in 41 have a member from BROKEN; the others stay as they are."""
    rows = arrivals(spark, sf_dir)
    kind = F.expr(f"arrival_no div 10 % {KINDS}")
    kinds = {f.name: f.dataType for f in rows.schema}

    def replaced(column: str) -> Column:
        value = F.col(column)
        for number, (name, bad) in enumerate(BROKEN, 1):
            if name == column:
                value = F.when(kind == number, F.lit(bad).cast(kinds[column])).otherwise(value)
        return value

    return rows.select(*[replaced(c).alias(c) for c in rows.columns])


def broken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events as another writer may have left them: null, 0 and negative ones among them."""
    number = F.col("event_id")
    return read_events(spark, sf_dir).select(
        F.when(number % 5 != 0, number % 7 - 1).alias("sequence_number"), F.when(number % 3 == 0, number % 4).alias("gap_size"))


def messages(readings: DataFrame) -> DataFrame:
    """Readings as JSON messages; members that are null are left out."""
    members = F.struct(*[F.col(column).alias(member) for member, column, _ in READING_FIELDS])
    text = F.to_json(members, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "ignoreNullFields": "true"})
    return readings.select("arrival_no", "received_at_utc", text.alias("value"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arrivals`` as JSON messages; some are cut off, some come from a writer without acquisition mode."""
    n = F.col("arrival_no")
    mode = F.when(n % 13 != 0, F.col("acquisition_mode"))
    whole = messages(arrivals(spark, sf_dir).withColumn("acquisition_mode", mode))
    return whole.withColumn("value", F.when(n % 37 == 0, F.substring("value", 1, 40)).otherwise(F.col("value")))


def pinned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session shown last per device: that of its first event, or one that has no readings."""
    e = numbered_events(spark, sf_dir)
    first = e.groupBy("device_id").agg(F.min(F.struct("ts", "event_id", "acquisition_session_id")).alias("_f"))
    number = _log_number()
    return first.select(
        "device_id",
        F.when(number % 10 == 3, "33333333-3333-4333-8333-333333333333")
        .otherwise(F.col("_f.acquisition_session_id"))
        .alias("pinned_session_id"),
    )


def _path() -> Column:
    return F.concat(F.lit("logs/"), F.col("device_id"), F.lit(".xml"))


def _log_number() -> Column:
    return F.expr("substring(device_id, 7)").cast("bigint")


def _log_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, _d, head, tail) of one well log per device: what stands before and after its data lines.

    Some documents use a prefix for the namespace, or another namespace or version; some are cut off, incomplete, or hold
    no log or two.
    """
    devices = read_events(spark, sf_dir).select(device_of(F.col("user_id")).alias("device_id")).distinct()
    d = F.col("_d")
    text = F.lit
    p = F.when(d % 4 == 2, "w:").otherwise("")
    depth_unit = F.when(d % 37 == 5, "km").when(d % 5 == 1, "ft").otherwise("m")

    def element(name: str, value: Column | str) -> Column:
        return F.concat(text("<"), p, text(f"{name}>"), F.lit(value) if isinstance(value, str) else value, text("</"), p, text(f"{name}>\n"))

    def opened(name: str, attributes: Column | str = "") -> Column:
        return F.concat(text("<"), p, text(name), F.lit(attributes) if isinstance(attributes, str) else attributes, text(">\n"))

    def closed(name: str) -> Column:
        return F.concat(text("</"), p, text(f"{name}>\n"))

    def where(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise("")

    def curve(mnemonic: str, unit: Column | str, null_value: str) -> Column:
        return F.concat(
            opened("logCurveInfo", f' uid="{mnemonic}"'), element("mnemonic", mnemonic), element("unit", unit),
            element("nullValue", null_value), closed("logCurveInfo"))

    mnemonics = (
        F.when(d % 43 == 3, "DEPT, DTIM, GR, SPP")
        .when(d % 61 == 6, "DEPT,DTIM,GR,SPP,TEMP,GR")
        .when(d % 3 == 1, "GR,SPP,TEMP,DEPT,DTIM")
        .otherwise("DEPT,DTIM,GR,SPP,TEMP"))
    units = (
        F.when(d % 43 == 3, F.concat(depth_unit, text(",,gAPI,psi")))
        .when(d % 61 == 6, F.concat(depth_unit, text(",,gAPI,psi,degC,gAPI")))
        .when(d % 47 == 2, "m,,gAPI")
        .when(d % 3 == 1, F.concat(text("gAPI, psi, degC,"), depth_unit, text(",")))
        .otherwise(F.concat(depth_unit, text(",,gAPI,psi,degC"))))
    namespace = F.when(d % 73 == 20, "http://www.witsml.org/schemas/131").otherwise("http://www.witsml.org/schemas/1series")
    version = F.when(d % 59 == 4, "1.3.1.1").otherwise("1.4.1.1")
    number = d.cast("string")
    has_log, has_data = d % 67 != 25, d % 89 != 35
    log = F.concat(
        opened("log", F.concat(text(' uidWell="W-'), number, text('" uidWellbore="'), F.when(d % 71 == 9, " ").otherwise("WB-1"), text('" uid="LOG-'), number, text('"'))),
        element("nameWell", F.concat(text(" Well &amp; "), number, text("\t"))),
        where(d % 71 != 13, element("nameWellbore", "Main <!-- > --> bore")),
        element("indexType", F.when(d % 53 == 1, "date time").otherwise("measured depth")),
        element("indexCurve", "DEPT"),
        curve("DEPT", depth_unit, "-999.25"), curve("DTIM", "", ""), curve("GR", "gAPI", "-999.25"),
        where(d % 41 != 7, curve("SPP", "psi", "")), curve("TEMP", "degC", ""))
    block = F.concat(opened("logData"), where(d % 79 != 30, element("mnemonicList", mnemonics)), element("unitList", units))
    xmlns = F.when(d % 4 == 2, ' xmlns:w="').otherwise(' xmlns="')
    head = F.concat(
        text('<?xml version="1.0"?>\n'), opened("logs", F.concat(xmlns, namespace, text('" version="'), version, text('"'))),
        where(has_log, F.concat(log, where(has_data, block))))
    tail = F.concat(
        text("<!-- -->"),  # ends what the last line may have begun
        where(has_log & has_data, closed("logData")),
        # a second block doesn't count, and neither do the lines in a comment
        where(has_log & (d % 3 == 0), F.concat(opened("logData"), element("data", "1,2"), closed("logData"))),
        text("<!-- <data>0</data> -->"),
        where(has_log, closed("log")), where(d % 67 == 8, F.concat(opened("log"), closed("log"))),
        where(d % 61 != 12, closed("logs")))
    return devices.withColumn("_d", _log_number()).select(_path().alias("path"), "_d", head.alias("head"), tail.alias("tail"))


LINES_PER_BLOCK = 1 << 16


def well_log_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, block, at, text): XML text of one well log per device, in fragments that each begin with a tag."""
    ends = _log_ends(spark, sf_dir).select("path", F.inline(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("block"), F.col("head").alias("text")),
        F.struct(F.lit(1 << 40).alias("block"), F.col("tail").alias("text")))))
    rn = F.col("line_no")
    tag = F.concat(F.when(F.col("_d") % 4 == 2, "w:").otherwise(""), F.lit("data>"))
    text = F.concat(
        F.lit("<"), tag, F.col("line"), F.lit("</"), tag, F.lit("\n"),
        # comments among the lines, some of which end behind the next line
        F.when(rn % 7 == 3, "<!-- a <").when(rn % 7 == 4, "-->").when(rn % 10 == 0, "<!-- <data>1,2</data> -->").otherwise(""))
    lines = well_log_lines(spark, sf_dir)
    # the line after an unfinished comment belongs to the comment, so it is repeated behind it
    commented = rn % 7 == 4
    return lines.select(
        "path", (F.floor(rn / LINES_PER_BLOCK)).cast("bigint").alias("block"), rn.alias("at"),
        F.when(commented, F.concat(text, F.lit("<"), tag, F.col("line"), F.lit("</"), tag)).otherwise(text).alias("text"),
    ).unionByName(ends.select("path", "block", F.lit(0).cast("bigint").alias("at"), "text"))


def well_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data lines of the same logs: (path, line_no, line, _d); some values are empty, null or no numbers."""
    e = numbered_events(spark, sf_dir, ["device_id"]).withColumn("_d", _log_number())
    event_id, d = F.col("event_id"), F.col("_d")
    depth = F.when(event_id % 499 == 0, "-999.25").otherwise(
        (1000.0 + F.col("rn") * 0.5 - (event_id % 7) * 0.25).cast("string")
    )
    time = (
        F.when(event_id % 401 == 0, "")
        .when(event_id % 907 == 0, "2023-12-01T00:00:00Z")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
    value = F.col("value").cast("decimal(12,2)")
    gamma = (
        F.when(event_id % 601 == 0, "12e3").when(event_id % 701 == 0, "-0.5").otherwise(value.cast("string"))
    )
    pressure = F.concat((8000 + event_id % 500).cast("string"), F.when(event_id % 13 == 0, " ").otherwise(""))
    temperature = (100.0 + (event_id % 40) * 0.5).cast("string")
    extra = F.when(event_id % 797 == 0, ",1").otherwise("")

    def line(*fields: Column) -> Column:
        return F.concat(F.concat_ws(",", *fields), extra)

    return e.select(
        _path().alias("path"),
        F.col("rn").alias("line_no"),
        F.when(d % 43 == 3, line(depth, time, gamma, pressure))
        .when(d % 61 == 6, line(depth, time, gamma, pressure, temperature, (value + 1).cast("string")))
        .when(d % 3 == 1, line(gamma, pressure, temperature, depth, time))
        .otherwise(line(depth, time, gamma, pressure, temperature))
        .alias("line"),
        "_d",
    )
