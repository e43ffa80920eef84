"""Keep costly expressions from being repeated by the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row.

    Projections above it refer to the result instead of inlining its expressions, and filters above it
    are not pushed below, where they would repeat the work.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
