"""A store of samples by message type, sorted by log and time, with its catalog beside it.

A folder for each message type holds files of rows in order of log and time, so a reader that asks for some messages, logs and times opens
those folders only, and in them skips files and row groups by the bounds in their footers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["log_id", "field", "seq", "t", "v", "msg_type"]


def write_store(samples: DataFrame, path: str, parts: int | None = None) -> None:
    """samples(log_id, msg_type, field, seq, t, v) as a store; an existing one is an error.

    Rows are dealt by ranges of (message, log, time): a message of any size is spread over tasks, and a task writes files for the few messages of its
    range.  A null message has a folder of its own.
    """
    parts = parts or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["msg_type", "log_id", "t", "seq"]
    sorted_rows = samples.select(*COLUMNS).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_rows.write.partitionBy("msg_type").parquet(f"{path}/samples")
    facts = samples.groupBy("msg_type", "log_id", "field").agg(F.count("*").alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    facts.repartitionByRange("log_id").sortWithinPartitions("log_id").write.parquet(f"{path}/catalog")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(msg_type, log_id, field, n, t_first, t_last): what the store holds, without a look at its samples."""
    return spark.read.parquet(f"{path}/catalog")


def read_store(spark: SparkSession, path: str, messages: Sequence[str] | None = None, logs: Sequence | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(log_id, field, seq, t, v, msg_type) of some messages and logs with low <= t <= high; None: all."""
    known = {f.name: f.dataType.simpleString() for f in catalog(spark, path).schema}
    # the names of folders are texts, whatever they look like
    rows = spark.read.schema(f"log_id {known['log_id']}, field string, seq long, t double, v double, msg_type string").parquet(f"{path}/samples")
    for condition, given in ((F.col("msg_type").isin(list(messages or ())), messages), (F.col("log_id").isin(list(logs or ())), logs), (F.col("t") >= F.lit(low), low), (F.col("t") <= F.lit(high), high)):
        rows = rows.where(condition) if given is not None else rows
    return rows
