"""Views of the events table as telemetry: a user is a log, an event type a series, its value the sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, whatever the session's time zone."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / F.lit(1e6)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, series, seq, t, v, k)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("user_id").alias("log_id"),
        F.col("event_type").alias("series"),
        F.col("event_id").alias("seq"),
        epoch_seconds(F.col("ts")).alias("t"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


#: Field names that the k property of an event stands for.
FIELDS = ["Lat", "Lng", "Alt", "AccX", "AccY", "AccZ", "Roll", "I"]


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, msg_type, field, series "msg_type.field", seq, t, v, k): the field comes from k."""
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("k") % len(FIELDS) + 1).cast("int"))
    rows = event_samples(spark, sf_dir).withColumnRenamed("series", "msg_type").withColumn("field", field)
    return rows.select("log_id", "msg_type", "field", F.concat_ws(".", "msg_type", "field").alias("series"), "seq", "t", "v", "k")
