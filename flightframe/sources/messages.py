"""Decoded messages: (log_id, sysid, msg_type, seq, fields map) as samples, texts, events and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages that are parameters, and that are texts.
PARAMETERS, TEXTS = ["PARM", "PARAM_VALUE"], ["MSG", "STATUSTEXT"]


def message_time(fields: Column, row: Column) -> Column:
    """Seconds from the first present of TimeUS, time_us, TimeMS, Time; a row number without any."""
    scale = {"TimeUS": 1e6, "time_us": 1e6, "TimeMS": 1e3, "Time": 1.0}
    return F.coalesce(*(F.try_element_at(fields, F.lit(name)).cast("double") / by for name, by in scale.items()), row.cast("double"))


def message_samples(messages: DataFrame) -> DataFrame:
    """messages(log_id, msg_type, seq, fields map<string,double>) -> one sample per field; parameters are left out."""
    row = F.row_number().over(Window.partitionBy("log_id", "msg_type").orderBy("seq")) - 1
    timed = messages.where(~F.col("msg_type").isin(PARAMETERS)).withColumn("row", row).withColumn("t", message_time(F.col("fields"), F.col("row")))
    return timed.select("log_id", "msg_type", "seq", "t", F.explode("fields").alias("field", "v")).withColumn("series", F.concat_ws(".", "msg_type", "field"))


def text_messages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(log_id, msg_type, seq, t, text, id) -> texts (log_id, t, text) and events (log_id, t, name, event_type)."""
    texts = rows.where(F.col("msg_type").isin(TEXTS)).select("log_id", "t", "text")
    told = texts.select("log_id", "t", F.concat(F.lit("MSG: "), "text").alias("name"), F.lit("INFO").alias("event_type"))
    coded = rows.where(F.col("msg_type") == "EV").select("log_id", "t", F.concat(F.lit("EV: "), F.col("id").cast("string")).alias("name"), F.lit("EV").alias("event_type"))
    return texts, told.unionByName(coded)
