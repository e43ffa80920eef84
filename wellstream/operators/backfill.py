"""Bring older versions of the readings table to the current columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellstream.schemas import ARRIVAL_COLUMNS, DEFAULT_MODE, READING_COLUMNS

# Contents of columns that older rows do not have.
LEGACY_WELL, LEGACY_WELLBORE = "LEGACY-WELL", "LEGACY-WELLBORE"
LEGACY_WELL_NAME, LEGACY_WELLBORE_NAME = "Legacy well (%s)", "Legacy wellbore (%s)"
LEGACY_OPERATION = "Stationary"

# Columns that each table version added to the one before it.
VERSION_COLUMNS = {
    1: ["device_id", "acquisition_session_id", "sequence_number", "pressure_psi", "temperature_celsius", "timestamp_utc"],
    2: ["well_id", "wellbore_id", "measured_depth_metres"],
    3: ["drilling_operation", "depth_change_rate_metres_per_hour"],
    4: ["gamma_ray_api"],
    5: ["well_name", "wellbore_name"],
    6: ["acquisition_mode"],
}


def columns_at(version: int) -> list[str]:
    known = {c for v, cs in VERSION_COLUMNS.items() if v <= version for c in cs}
    return [c for c in READING_COLUMNS if c in known]


def _fill(df: DataFrame, column: str, value: Column) -> DataFrame:
    present = F.coalesce(F.col(column), value) if column in df.columns else value
    return df.withColumn(column, present)


def add_well_context(df: DataFrame) -> DataFrame:
    """B1."""
    df = _fill(df, "well_id", F.lit(LEGACY_WELL))
    df = _fill(df, "wellbore_id", F.lit(LEGACY_WELLBORE))
    return _fill(df, "measured_depth_metres", F.lit(0.0))


def add_operation(df: DataFrame) -> DataFrame:
    """B2."""
    return _fill(_fill(df, "drilling_operation", F.lit(LEGACY_OPERATION)), "depth_change_rate_metres_per_hour", F.lit(0.0))


def add_gamma_ray(df: DataFrame) -> DataFrame:
    """B3."""
    return _fill(df, "gamma_ray_api", F.lit(0.0))


def add_names(df: DataFrame) -> DataFrame:
    """An empty name counts as absent."""
    for column, pattern, source in (
        ("well_name", LEGACY_WELL_NAME, "well_id"), ("wellbore_name", LEGACY_WELLBORE_NAME, "wellbore_id"),
    ):
        if column in df.columns:
            df = df.withColumn(column, F.nullif(F.col(column), F.lit("")))
        df = _fill(df, column, F.format_string(pattern, source))
    return df


def add_mode(df: DataFrame) -> DataFrame:
    """B5."""
    return _fill(df, "acquisition_mode", F.lit(DEFAULT_MODE))


STEPS = [add_well_context, add_operation, add_gamma_ray, add_names, add_mode]


def row_version() -> Column:
    """The newest table version of which a row has a column that is not null, or 0. A file's version is that of its newest row."""
    present = [(v, F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()) for v, columns in VERSION_COLUMNS.items()]
    return F.coalesce(*[F.when(found, v) for v, found in reversed(present)], F.lit(0))


def fill(df: DataFrame) -> DataFrame:
    """All steps, in order; what a row has stays, other columns too."""
    for step in STEPS:
        df = step(df)
    return df


def with_payload(df: DataFrame) -> DataFrame:
    """The content column, rebuilt from the current reading columns."""
    return df.withColumn("payload", F.struct(*READING_COLUMNS))


def upgrade(df: DataFrame) -> DataFrame:
    """Any older version to the current one; a projection, so it costs no shuffle."""
    extra = [c for c in ARRIVAL_COLUMNS if c in df.columns]
    return with_payload(fill(df).select(*READING_COLUMNS, *extra))
