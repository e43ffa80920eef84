"""Validation rules as Boolean columns (V1, V2) and their reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellstream.schemas import EMPTY_SESSION, MODES, OPERATIONS

# Reasons of the rejects table.
BAD_JSON = "invalid json"
BLANK_DEVICE = "device identifier is empty"
EMPTY_SESSION_ID = "acquisition session is empty"
BAD_SEQUENCE = "sequence number must be greater than zero"
BLANK_WELL = "well identifier is empty"
BLANK_WELL_NAME = "well name is empty"
BLANK_WELLBORE = "wellbore identifier is empty"
BLANK_WELLBORE_NAME = "wellbore name is empty"
BAD_DEPTH = "measured depth must be finite and not negative"
BAD_OPERATION = "drilling operation is invalid"
BAD_RATE = "drilling operation and depth-change rate are inconsistent"
BAD_GAMMA = "gamma ray must be finite and not negative"
BAD_MODE = "acquisition mode is invalid"

INFINITY = float("inf")


def is_blank(c: Column) -> Column:
    """Null, empty or only white space, that of Unicode included. Most texts begin with an ASCII character that is none."""
    text = F.coalesce(c, F.lit(""))
    return ~(F.substring(text, 1, 1).between("!", "~") | text.rlike(r"(?U)\S"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != INFINITY)


def is_measure(c: Column) -> Column:
    """Finite and not negative."""
    return is_finite(c) & (c >= 0)


def rate_matches_operation(operation: Column, rate: Column) -> Column:
    """V2: the sign of a finite rate decides the only operation it may come with."""
    implied = F.when(rate > 0, "DrillingAhead").when(rate < 0, "TrippingOut").otherwise("Stationary")
    return F.coalesce(is_finite(rate) & (operation == implied), F.lit(False))


def reject_reason() -> Column:
    """First broken rule of a typed reading, or null (V1.2 to V1.12 and the mode check of the table)."""
    rules = [
        (is_blank(F.col("device_id")), BLANK_DEVICE),
        (is_blank(F.col("acquisition_session_id")) | (F.col("acquisition_session_id") == EMPTY_SESSION),
         EMPTY_SESSION_ID),
        (F.coalesce("sequence_number", F.lit(0)) <= 0, BAD_SEQUENCE),
        (is_blank(F.col("well_id")), BLANK_WELL),
        (is_blank(F.col("well_name")), BLANK_WELL_NAME),
        (is_blank(F.col("wellbore_id")), BLANK_WELLBORE),
        (is_blank(F.col("wellbore_name")), BLANK_WELLBORE_NAME),
        (~is_measure(F.col("measured_depth_metres")), BAD_DEPTH),
        (~F.coalesce(F.col("drilling_operation").isin(OPERATIONS), F.lit(False)), BAD_OPERATION),
        (~rate_matches_operation(F.col("drilling_operation"), F.col("depth_change_rate_metres_per_hour")), BAD_RATE),
        (~is_measure(F.col("gamma_ray_api")), BAD_GAMMA),
        (~F.coalesce(F.col("acquisition_mode").isin(MODES), F.lit(False)), BAD_MODE),
    ]
    return F.coalesce(*[F.when(broken, reason) for broken, reason in rules])
