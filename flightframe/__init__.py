"""Telemetry-log analytics on Spark DataFrames."""
