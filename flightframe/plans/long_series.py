"""Queries: the same rows as other queries, by scans that let a series be longer than a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.operators import align, calc, scans, segments
from flightframe.operators.long_spectrum import long_spectrum
from flightframe.plans import joins
from flightframe.plans.base import ORACLES, query, rounded, rounded_all
from flightframe.plans.calculated import _angles, _fast
from flightframe.plans.joins import SERIES, coarse
from flightframe.plans.timing import GAP
from flightframe.sources.events import event_samples


@query("rate1_long_series", ORACLES["rate1_effective_rate"])
def effective_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.data_rate(event_samples(spark, sf_dir), long=True).withColumn("rate", F.round("rate", 12))


@query("seg1_long_series", ORACLES["seg1_gap_segments"])
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.gap_segments(event_samples(spark, sf_dir), GAP, long=True).withColumns({"duration": rounded("duration"), "fs": F.round("fs", 12)})


@query("seg2_long_series", ORACLES["seg2_fine_segments"])
def fine_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.fine_segments(event_samples(spark, sf_dir), GAP, long=True).withColumns({"duration": rounded("duration"), "median_dt": rounded("median_dt"), "fs": F.round("fs", 12)})


@query("join1_long_series", ORACLES["join1_low_rate_pair"])
def low_rate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(align.low_rate_pair(event_samples(spark, sf_dir), "click", "view", long=True), "va", "vb")


@query("join6_long_series", ORACLES["join6_inside_spans"])
def inside_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.inside_spans(spark, sf_dir, long=True)


@query("join9_long_series", ORACLES["join9_nearest_message"])
def nearest_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_message(spark, sf_dir, long=True)


@query("win8_long_series", ORACLES["win8_unwrap"])
def unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(scans.unwrapped(_angles(spark, sf_dir)), "v").select("log_id", "series", "seq", "v")


@query("win9_long_series", ORACLES["win9_forward_fill"])
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.outer_join(coarse(spark, sf_dir).where(F.col("series").isin(SERIES)), SERIES, "ffill", long=True)


@query("win11_long_series", ORACLES["win11_vibration"])
def vibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(calc.long_vibration(_fast(spark, sf_dir)), "v").select("log_id", "series", "seq", "v")


@query("sig1_long_series", ORACLES["sig1_spectrum"])
def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(long_spectrum(event_samples(spark, sf_dir).withColumn("fs", F.lit(10.0))), "freq", "mag")
