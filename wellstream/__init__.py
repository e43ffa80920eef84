"""Wellstream: sensor-stream analytics for wells on PySpark DataFrames."""
