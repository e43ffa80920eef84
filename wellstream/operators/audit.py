"""Constraints of the two tables, checked instead of enforced (V3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellstream.functions.predicates import is_measure, rate_matches_operation
from wellstream.schemas import MODES, NATURAL_KEY, OPERATIONS


def reading_constraints() -> dict[str, Column]:
    """Name to condition that every row has to meet."""
    operation, rate = F.col("drilling_operation"), F.col("depth_change_rate_metres_per_hour")
    return {
        "sequence_number": F.col("sequence_number") > 0,
        "measured_depth": is_measure(F.col("measured_depth_metres")),
        "drilling_operation": operation.isin(OPERATIONS),
        "depth_change_rate": rate_matches_operation(operation, rate),
        "gamma_ray_api": is_measure(F.col("gamma_ray_api")),
        "acquisition_mode": F.col("acquisition_mode").isin(MODES),
    }


def event_constraints() -> dict[str, Column]:
    return {c: F.col(c).isNull() | (F.col(c) > 0) for c in ("sequence_number", "gap_size")}


def _report(df: DataFrame, table: str, constraints: dict[str, Column]) -> DataFrame:
    counts = df.agg(*[
        F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in constraints.items()
    ], F.count(F.lit(1)).alias("_rows"))
    return counts.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(name).alias("constraint_name"), F.col(name).alias("violations")) for name in constraints
    ])).alias("_c")).select(
        F.lit(table).alias("table_name"), "_c.constraint_name", F.col("_rows").alias("rows"), "_c.violations"
    )


def constraint_report(readings: DataFrame, events: DataFrame) -> DataFrame:
    """V3: checked rows and violations per constraint; one pass over each table."""
    return _report(readings, "readings", reading_constraints()).unionByName(
        _report(events, "events", event_constraints())
    )


def violations(readings: DataFrame) -> DataFrame:
    """Rows that break a constraint, with the names of all broken ones."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in reading_constraints().items()
    ]))
    return readings.withColumn("broken", F.concat_ws(",", broken)).where(F.col("broken") != "")


def repeated_keys(readings: DataFrame) -> DataFrame:
    """Natural keys that are not unique; Parquet has no primary key."""
    return readings.groupBy(*NATURAL_KEY).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
