"""The logs dimension: times, labels, shifts and naming; requests of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.operators.series import SERIES


def log_times(samples: DataFrame) -> DataFrame:
    """(log_id, t_first, t_last, duration): least first and greatest last sample (in file order) of the log's series;
    0 for logs without a finite time."""
    place = F.when(F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")), F.col("seq"))
    ends = samples.groupBy(*SERIES).agg(F.min_by("t", place).alias("a"), F.max_by("t", place).alias("b"))
    times = ends.groupBy("log_id").agg(F.coalesce(F.min("a"), F.lit(0.0)).alias("t_first"), F.coalesce(F.max("b"), F.lit(0.0)).alias("t_last"))
    return times.withColumn("duration", F.greatest(F.lit(0.0), F.col("t_last") - F.col("t_first")))


def total_duration(samples: DataFrame) -> DataFrame:
    """(log_id, total): greatest less least of all first and last times."""
    ends = samples.groupBy(*SERIES).agg(F.min_by("t", "seq").alias("a"), F.max_by("t", "seq").alias("b"))
    return ends.groupBy("log_id").agg((F.max(F.greatest("a", "b")) - F.min(F.least("a", "b"))).alias("total"))


def labelled(logs: DataFrame, order: str, ranges: int = 200) -> DataFrame:
    """logs with label F1, F2, .. by a whole-number order column.

    Logs are numbered within ranges of about equal size; the ranges' counts, so many rows, give each range its start.
    """
    cuts = F.broadcast(logs.agg(F.percentile_approx(order, F.array(*(F.lit(k / ranges) for k in range(1, ranges)))).alias("__cuts")))  # one row
    placed = logs.join(cuts).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("__range", before.alias("__before")))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return placed.withColumn("__rank", rank).join(starts, "__range").withColumn("label", F.concat(F.lit("F"), (F.col("__before") + F.col("__rank")).cast("string"))).drop("__range", "__rank", "__before")


def time_shift(logs: DataFrame, zero_align: str = "auto") -> DataFrame:
    """logs(.., t_first, user_offset) with shift: -t_first if aligned ("on", or "auto" with several logs), + offset."""
    several = F.lit(zero_align == "on")
    if zero_align == "auto":
        logs = logs.join(F.broadcast(logs.agg((F.count("*") > 1).alias("__several"))))  # one row
        several = F.col("__several")
    shift = F.when(several, -F.col("t_first")).otherwise(0.0) + F.coalesce("user_offset", F.lit(0.0))
    return logs.withColumn("shift", shift).drop("__several")


def shifted(samples: DataFrame, logs: DataFrame) -> DataFrame:
    """samples in aligned time, by the shift of their log."""
    return samples.join(logs.select("log_id", "shift"), "log_id").withColumn("t", F.col("t") + F.col("shift")).drop("shift")


def mode_source(logs: DataFrame, choice: DataFrame) -> DataFrame:
    """choice(view, active_id, wanted string) -> (view, log_id): none -> no log, active or an unknown id -> the active
    log, else the wanted one."""
    known = logs.select(F.col("log_id").alias("known"))
    found = choice.join(known, F.col("wanted").try_cast("long") == F.col("known"), "left")
    return found.select("view", F.when(F.col("wanted") != "none", F.coalesce("known", "active_id")).alias("log_id"))


def display_name(label: Column, series: Column, logs: Column) -> Column:
    return F.when(logs > 1, F.concat(F.lit("["), label, F.lit("] "), series)).otherwise(series)


def column_name(label: Column, series: Column, logs: Column) -> Column:
    return F.when(logs > 1, F.concat(label, F.lit("."), series)).otherwise(series)


def lookup(samples: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(log_id, name) -> (log_id, name, seq, t, v): the series of that name, else with "CALC." put before it or
    taken off; unknown names have no rows.  Samples without a time get their row number as time."""
    bare = F.regexp_replace("name", r"^CALC\.", "")
    other = F.when(F.col("name").startswith("CALC."), bare).otherwise(F.concat(F.lit("CALC."), F.col("name")))
    wanted = requests.select("log_id", "name", F.posexplode(F.array("name", other)).alias("rank", "series"))
    found = wanted.join(samples.select(*SERIES).distinct(), list(SERIES)).groupBy("log_id", "name").agg(F.min_by("series", "rank").alias("series"))
    rows = samples.join(found, list(SERIES))
    row = (F.row_number().over(Window.partitionBy("log_id", "name").orderBy("seq")) - 1).cast("double")
    return rows.select("log_id", "name", "seq", F.coalesce("t", row).alias("t"), "v")


def distinct_requests(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """series(log_id, pos, series), pairs(log_id, pos, x_series, y_series) -> (log_id, series, first): distinct items,
    with the position of the first request."""
    items = series.select("log_id", (F.col("pos") * 2).alias("first"), "series").unionByName(pairs.select("log_id", F.posexplode(F.array("x_series", "y_series")).alias("k", "series"), "pos").select("log_id", (F.col("pos") * 2 + F.col("k")).alias("first"), "series"))
    return items.where("series <> ''").groupBy(*SERIES).agg(F.min("first").alias("first"))
