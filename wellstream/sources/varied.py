"""Texts, numbers and header fields of many kinds, one per event: inputs of label and log-text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellstream.operators.welllog import VERSION
from wellstream.schemas import LOG_HEADER_SCHEMA, LOG_NAMESPACE
from wellstream.sources.derived import read_events


def _choice(number: Column, *values) -> Column:
    """The value at ``number`` modulo their count; values are columns, plain values or None."""
    out = F.lit(None)
    for place, value in enumerate(values):
        if value is not None:
            out = F.when(number % len(values) == place, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the labels of a reading are made from; any of it may be null, empty or unknown."""
    n = F.col("event_id")
    run = F.concat(F.lower(F.lpad(F.hex(n * 2654435761 % 4294967296), 8, "0")), F.lit("-0000-4000-8000-0000000000ab"))
    return read_events(spark, sf_dir).select(
        n.alias("device_id"),
        _choice(n, run, run, None, run, run).alias("acquisition_session_id"),
        _choice(n, F.concat(F.lit("Well "), n.cast("string")), "North-Sea b", None, "", "-- ", "Ω7é", F.concat(F.lit("w"), n.cast("string"), F.lit(")"))).alias("well_name"),
        _choice(n, "Stationary", "DrillingAhead", "TrippingOut", "Reaming", None).alias("drilling_operation"),
        _choice(n, "RealTime", "HistoricalImport", None, "Replayed").alias("acquisition_mode"),
        _choice(n, 0.0, -0.04, 0.25, -0.25, n * 100 + 1234.56, n * -1000.25, 0.05, -0.0, n / 20, 999.95, -999.94).cast("double")
        .alias("depth_change_rate_metres_per_hour"),
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and time texts, good and bad."""
    n, ts = F.col("event_id"), F.col("ts")
    v = (n % 100000 / 100).cast("decimal(12,2)").cast("string")

    def local(minutes: int, pattern: str, offset: str) -> Column:
        return F.concat(F.date_format(F.timestamp_micros(F.unix_micros(ts) + minutes * 60_000_000), pattern), F.lit(offset))

    seconds = "yyyy-MM-dd'T'HH:mm:ss"
    return read_events(spark, sf_dir).select(
        n.alias("event_id"),
        _choice(
            n, v, F.concat(F.lit("+"), v), F.concat(F.lit("-"), v), F.concat(v, F.lit("-")), F.concat(v, F.lit("+")),
            F.concat(F.lit("+"), v, F.lit("-")), F.concat(v, F.lit("e1")), F.concat(F.lit("."), (n % 1000).cast("string")),
            F.concat((n % 1000).cast("string"), F.lit(".")), "", "NaN", "0x1F", "1d", ".", "-", None, "- 1").alias("number"),
        _choice(
            n, local(0, seconds, "Z"), local(120, seconds, "+02:00"), local(-330, seconds, "-05:30"), local(0, seconds, ""),
            local(0, "yyyy-MM-dd", ""), local(0, "yyyy-MM-dd'T'HH:mm", "Z"), local(0, seconds, ".500Z"), local(840, seconds, "+14:00"),
            "2024-13-01T00:00:00Z", local(0, "yyyy-MM-dd HH:mm:ss", "Z"), "2024-02-30T00:00:00Z", "", None, local(345, seconds, ".25+05:45"))
        .alias("time"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sound log header per event, with units of many kinds."""
    n = F.col("event_id")
    units = F.concat_ws(
        ",", _choice(n, "m", "ft", "km", "M", "", " ft ", "m"), F.lit(""), _choice(F.floor(n / 7), "gAPI", "gAPI", "gAPI", "GAPI", "api"),
        _choice(F.floor(n / 5), "psi", "psi", "kPa", "psi"), _choice(F.floor(n / 3), "degC", "degC", "degF"))
    curves = [T.Row(mnemonic=m, unit=None, null_value=None) for m in ("DEPT", "DTIM", "GR", "SPP", "TEMP")]
    values = {
        "path": n.cast("string"), "malformed": F.lit(False), "xmlns": F.lit(LOG_NAMESPACE), "version": F.lit(VERSION),
        "log_count": F.lit(1), "index_type": F.lit("measured depth"), "index_curve": F.lit("DEPT"), "has_log_data": F.lit(True),
        "curves": F.array(*[F.struct(*[F.lit(x).cast("string").alias(k) for k, x in c.asDict().items()]) for c in curves]),
        "mnemonic_list": F.lit("DEPT,DTIM,GR,SPP,TEMP"), "unit_list": units, "parts": F.array(),
    }
    return read_events(spark, sf_dir).select(*[
        values.get(f.name, F.lit("x")).cast(f.dataType).alias(f.name) for f in LOG_HEADER_SCHEMA])
