"""Data rates and gap segments (gaps and islands).

With long=True steps, medians and segment numbers come from scans over pieces, so a series may be longer than a task; results
are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightframe.operators import scans
from flightframe.operators.series import SERIES, so_far, whole, with_dt


def data_rate(samples: DataFrame, keys: Sequence[str] = SERIES, pause_s: float = 3.0, pause_medians: float = 5.0, long: bool = False) -> DataFrame:
    """(keys, rate): 1 / mean of the steps that are no pause; without any, 1 / median; below two samples 0."""
    steps = (scans.with_dt if long else with_dt)(samples, keys).withColumn("limit", F.greatest(F.lit(pause_s), pause_medians * F.col("median_dt")))
    active = F.avg(F.when((F.col("dt") > 0) & (F.col("dt") <= F.col("limit")), F.col("dt")))
    rates = steps.groupBy(*keys).agg(active.alias("mean"), F.first("median_dt").alias("median"))
    return rates.select(*keys, F.coalesce(1 / F.nullif("mean", F.lit(0.0)), 1 / F.nullif("median", F.lit(0.0)), F.lit(0.0)).alias("rate"))


def split_at_gaps(samples: DataFrame, multiplier: float, min_gap_s: float, keys: Sequence[str] = SERIES, long: bool = False) -> DataFrame:
    """samples with row, dt, median_dt and segment: a new one starts after a step over max(multiplier medians, min_gap)."""
    gap = F.when(F.col("dt") > F.greatest(multiplier * F.col("median_dt"), F.lit(min_gap_s)), 1).otherwise(0)
    if long:
        return scans.running_sum(scans.with_dt(samples, keys).withColumn("segment", gap), "segment", ["t", "seq"], keys).drop(scans.PIECE)
    return with_dt(samples, keys).withColumn("segment", F.sum(gap).over(so_far(keys)))


def _spans(split: DataFrame, keys: Sequence[str], long: bool = False) -> DataFrame:
    every = (*keys, "segment")
    if long:
        split = scans.stored(split, "split")
        inside = split.withColumn("from", F.lit(None).cast("long"))
    else:
        inside = split.withColumn("from", F.min("row").over(Window.partitionBy(*every)))
    positive = F.when((F.col("dt") > 0) & (F.col("row") > F.col("from")), F.col("dt"))
    spans = inside.groupBy(*every).agg(
        F.min("row").alias("start_idx"),
        F.max("row").alias("end_idx"),
        F.min("t").alias("start_t"),
        F.max("t").alias("end_t"),
        F.count("*").alias("samples"),
        F.first("median_dt").alias("series_median_dt"),
        (F.lit(None).cast("double") if long else F.median(positive)).alias("own_median_dt"),
    )
    if not long:
        return spans
    # the first row of a segment has its step from the one before
    starts = spans.select(*(F.col(k).alias(f"__{k}") for k in every), F.col("start_idx").alias("__start"))
    same = F.col("row") == F.col("__start")
    for k in every:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    own = scans.medians(split.where("dt > 0").join(starts, same, "left_anti"), "dt", every).select(*(F.col(k).alias(f"__{k}") for k in every), "median")
    same = F.lit(True)
    for k in every:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return spans.join(own, same, "left").withColumn("own_median_dt", F.col("median")).drop("median", *(f"__{k}" for k in every))


def gap_segments(samples: DataFrame, multiplier: float = 20.0, min_gap_s: float = 15.0, min_samples: int = 5, keys: Sequence[str] = SERIES, long: bool = False) -> DataFrame:
    """(keys, idx, start_idx, end_idx, start_t, end_t, duration, samples, fs, is_longest).

    Segments below min_samples and one second go unless all are like that; the longest is the first of the longest
    duration, then of most samples.
    """
    spans = _spans(split_at_gaps(samples.select(*keys, "t", "seq"), multiplier, min_gap_s, keys, long), keys, long).withColumn("duration", F.col("end_t") - F.col("start_t"))
    large = (F.col("samples") >= min_samples) | (F.col("duration") >= 1.0)
    kept = spans.withColumn("large", large).withColumn("any", F.max("large").over(whole(keys))).where("large or not any")
    order = Window.partitionBy(*keys).orderBy("start_idx")
    best = Window.partitionBy(*keys).orderBy(F.desc("duration"), F.desc("samples"), "start_idx")
    return kept.select(
        *keys,
        (F.row_number().over(order) - 1).alias("idx"),
        "start_idx",
        "end_idx",
        "start_t",
        "end_t",
        "duration",
        "samples",
        F.when((F.col("duration") > 0) & (F.col("samples") > 1), (F.col("samples") - 1) / F.col("duration")).otherwise(0.0).alias("fs"),
        (F.row_number().over(best) == 1).alias("is_longest"),
    )


def fine_segments(samples: DataFrame, multiplier: float = 20.0, min_gap_s: float = 0.05, keys: Sequence[str] = SERIES, long: bool = False) -> DataFrame:
    """(keys, segment, start_idx, end_idx, start_t, end_t, duration, samples, median_dt, fs); none is dropped."""
    spans = _spans(split_at_gaps(samples.select(*keys, "t", "seq"), multiplier, min_gap_s, keys, long), keys, long)
    median = F.coalesce("own_median_dt", "series_median_dt", F.lit(0.0))
    duration = F.col("end_t") - F.col("start_t")
    fs = F.when(duration > 0, (F.col("samples") - 1) / duration).when(F.col("median_dt") > 0, 1 / F.col("median_dt")).otherwise(0.0)
    return spans.withColumn("median_dt", median).select(*keys, "segment", "start_idx", "end_idx", "start_t", "end_t", duration.alias("duration"), "samples", "median_dt", fs.alias("fs"))


def longest_segment(samples: DataFrame, multiplier: float = 20.0, min_gap_s: float = 0.05, keys: Sequence[str] = SERIES, many: int = 100) -> DataFrame:
    """One row per series: of the segments with over `many` samples the longest; without one, that of most samples."""
    spans = fine_segments(samples, multiplier, min_gap_s, keys)
    big = F.col("samples") > many
    order = Window.partitionBy(*keys).orderBy(big.desc(), F.when(big, F.col("duration")).otherwise(F.col("samples")).desc(), "start_idx")
    ranked = spans.withColumn("n_segments", F.count("*").over(whole(keys))).withColumn("rank", F.row_number().over(order))
    return ranked.where("rank = 1").drop("rank")


def filter_segment(samples: DataFrame, segments: DataFrame, mode: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """samples of the longest segment or of index `mode`; series without such a segment, or left empty, stay whole.

    Adds filtered boolean: whether the series was cut.
    """
    if mode == "all":
        return samples.withColumn("filtered", F.lit(False))
    chosen = segments.where("is_longest" if mode == "longest" else F.col("idx") == int(mode)).select(*keys, "start_t", "end_t")
    marked = samples.join(chosen, list(keys), "left").withColumn("inside", F.coalesce(F.col("t").between(F.col("start_t"), F.col("end_t")), F.lit(False)))
    return marked.withColumn("filtered", F.max("inside").over(whole(keys))).where("inside or not filtered").drop("start_t", "end_t", "inside")


def spectrum_segment(samples: DataFrame, multiplier: float = 20.0, min_gap_s: float = 0.05, keys: Sequence[str] = SERIES) -> DataFrame:
    """samples of the segment with most samples (the first of them), with fs = 1 / its median positive step."""
    in_segment = Window.partitionBy(*keys, "segment")
    split = split_at_gaps(samples, multiplier, min_gap_s, keys).withColumn("from", F.min("row").over(in_segment)).withColumn("size", F.count("*").over(in_segment))
    best = split.withColumn("best", F.min(F.struct(-F.col("size"), "from")).over(whole(keys))).where(F.col("from") == F.col("best.from"))
    own = F.median(F.when((F.col("dt") > 0) & (F.col("row") > F.col("from")), F.col("dt"))).over(whole(keys))
    duration = F.max("t").over(whole(keys)) - F.min("t").over(whole(keys))
    rated = best.withColumn("own", own).withColumn("duration", duration)
    fs = F.when(F.col("median_dt").isNull(), 0.0).when(F.col("own") > 0, 1 / F.col("own")).when(F.col("duration") > 0, (F.col("size") - 1) / F.col("duration")).otherwise(0.0)
    return rated.withColumn("fs", fs).drop("row", "dt", "median_dt", "segment", "from", "size", "best", "own", "duration")


def display_bounds(segments: DataFrame, logs: DataFrame, keys: Sequence[str], mode: str = "longest") -> DataFrame:
    """(keys, low, high): least start and greatest end of the chosen segments in the logs' aligned time."""
    chosen = segments.where("is_longest" if mode == "longest" else F.col("idx") == int(mode)).join(logs.select("log_id", "shift"), "log_id")
    return chosen.groupBy(*keys).agg(F.min(F.col("start_t") + F.col("shift")).alias("low"), F.max(F.col("end_t") + F.col("shift")).alias("high"))
