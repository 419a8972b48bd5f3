"""Scans over pieces against the windows over whole series, with few rows to a piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightframe.functions import angles
from flightframe.operators import align, calc, long_spectrum, scans, segments, series, spectrum


@pytest.fixture
def small_pieces(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def samples(spark, n=900, odd=False):
    """One long series, a middle one and several of one row."""
    rng = np.random.default_rng(8)
    rows, seq = [], 0
    for log, name, size in ((1, "ATT.Yaw", n), (1, "GPS.Alt", n // 7), (2, "ATT.Yaw", 1), (3, "GPS.Alt", 1), (None, "ATT.Yaw", 5), (2, "GPS.Alt", 2)):
        t = np.cumsum(np.where(rng.random(size) < 0.03, 40.0, rng.choice([0.0, 0.1, 0.2, 0.5], size)))
        v = np.cumsum(rng.normal(0, 60, size)) % 360 - 180
        for i in range(size):
            seq += 1
            value = float("nan") if odd and seq % 97 == 0 else float(v[i])
            rows.append((log, name, seq, float(t[i]), value))
    return spark.createDataFrame(rows, "log_id long, series string, seq long, t double, v double").repartition(5)


def same(a, b, *order, digits=9):
    columns = a.columns
    assert sorted(columns) == sorted(b.columns)
    plain = lambda df: sorted((tuple(round(x, digits) if isinstance(x, float) and x == x else str(x) for x in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    got, expected = plain(a), plain(b)
    assert len(got) == len(expected)
    for x, y in zip(got, expected, strict=True):
        assert x == pytest.approx(y, abs=1e-6) if all(isinstance(v, float) for v in x) else x == y


def test_pieces_part_a_long_series(small_pieces):
    cut = scans.pieces(samples(small_pieces), ["t", "seq"])
    counts = cut.where("log_id = 1 and series = 'ATT.Yaw'").groupBy("__piece").count().collect()
    assert len(counts) > 5 and max(r["count"] for r in counts) < 300


def test_steps_and_medians(small_pieces):
    df = samples(small_pieces)
    same(scans.with_dt(df).drop("__piece"), series.with_dt(df))
    got = {(r.log_id, r.series): r["median"] for r in scans.medians(df, "v").collect()}
    assert got == {(r.log_id, r.series): r.m for r in df.groupBy("log_id", "series").agg(F.median("v").alias("m")).collect()}


@pytest.mark.parametrize("function", [segments.data_rate, segments.gap_segments, segments.fine_segments])
def test_rates_and_segments(small_pieces, function):
    df = samples(small_pieces)
    same(function(df, long=True), function(df))


def test_unwrap(small_pieces):
    df = samples(small_pieces)
    same(scans.unwrapped(df), angles.unwrap(df), digits=6)


def test_interpolation_takes_neighbours_from_other_pieces(small_pieces):
    df = samples(small_pieces).where("log_id is not null")
    one = df.dropDuplicates(["log_id", "series", "t"])
    same(align.low_rate_pair(one, "ATT.Yaw", "GPS.Alt", long=True), align.low_rate_pair(one, "ATT.Yaw", "GPS.Alt"), digits=6)
    ends = small_pieces.createDataFrame([(1, -5.0, 1.0), (1, 1e6, 9.0)], "log_id long, t double, v double")
    base = one.where("series = 'ATT.Yaw' and log_id = 1").select("log_id", "t", "seq")
    same(align.interpolate(base, ends, long=True), align.interpolate(base, ends), digits=6)


def test_fill_over_many_pieces(small_pieces):
    df = samples(small_pieces, odd=True).where("log_id is not null").withColumn("v", F.when(F.col("seq") % 50 == 0, F.col("v")).otherwise(F.lit("NaN").cast("double")))
    names = ["ATT.Yaw", "GPS.Alt"]
    same(align.outer_join(df, names, "ffill", long=True), align.outer_join(df, names, "ffill"))


def test_spans_and_messages_of_other_pieces(small_pieces):
    df = samples(small_pieces)
    spans = small_pieces.createDataFrame([(1, 3.0, 900.0), (1, 5.0, 6.0), (1, 2000.0, 2001.0), (2, -9.0, -5.0), (7, 0.0, 1.0)], "log_id long, start_t double, end_t double")
    same(align.inside_spans(df, spans, long=True), align.inside_spans(df, spans))
    messages = df.where("seq % 60 = 0").select("log_id", "t", "seq", F.concat(F.lit("m"), "seq").alias("text"))
    asked = df.where("seq % 7 = 0").select("log_id", F.col("seq").alias("query"), F.round("t", 1).alias("at"))
    same(align.nearest_message(messages, asked, long=True), align.nearest_message(messages, asked))


@pytest.mark.parametrize("odd", [False, True])
def test_vibration_by_composed_maps(small_pieces, odd):
    df = samples(small_pieces, odd=odd).withColumn("t", F.col("t") / 20)
    got = {(r.log_id, r.series, r.seq): r.v for r in calc.long_vibration(df).collect()}
    expected = {(r.log_id, r.series, r.seq): r.v for r in calc.vibration(df).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-12, abs=1e-12, nan_ok=True) for k, v in expected.items())


@pytest.mark.parametrize("unbalanced", [16, 0])
def test_long_spectra(small_pieces, monkeypatch, unbalanced):
    monkeypatch.setattr(long_spectrum, "UNBALANCED", unbalanced)  # 0: all by chirps
    rng = np.random.default_rng(12)
    rows = [(n, "x", k, k / 50, float(v), 50.0 if n != 11 else 0.0) for n in (1, 2, 3, 8, 11, 97, 360, 1021, 1024) for k, v in enumerate(rng.normal(size=n).cumsum())]
    df = small_pieces.createDataFrame(rows, "log_id long, series string, seq long, t double, v double, fs double").repartition(4)
    got, expected = ({(r.log_id, r.bin): (r.freq, r.mag) for r in f(df).collect()} for f in (long_spectrum.long_spectrum, spectrum.spectrum))
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_spectrum_of_one_series_spreads_over_tasks(small_pieces):
    n = 1 << 16
    df = small_pieces.range(n).selectExpr("1L as log_id", "'x' as series", "id as seq", "id / 100.0d as t", "sin(id * 0.37) + (id % 13) as v", "100d as fs")
    got = long_spectrum.long_spectrum(df).toPandas().sort_values("bin")
    v = np.sin(np.arange(n) * 0.37) + np.arange(n) % 13
    np.testing.assert_allclose(got["mag"].to_numpy(), np.abs(np.fft.rfft((v - v.mean()) * np.hanning(n))) * 2 / n, rtol=1e-9, atol=1e-12)


def test_scans_of_nothing(small_pieces):
    none = samples(small_pieces).limit(0)
    assert segments.data_rate(none, long=True).count() == 0 and segments.gap_segments(none, long=True).count() == 0
    assert scans.unwrapped(none).count() == 0 and calc.long_vibration(none).count() == 0


def test_only_series_in_several_pieces_are_handed_states(spark):
    rows = spark.range(3000).select((F.col("id") % 50).alias("log_id"), F.lit("a").alias("series"), F.col("id").alias("seq"), F.col("id").cast("double").alias("t"), F.lit(1.0).alias("v"))
    cut = scans.pieces(rows, ["t", "seq"], parts=7)
    states = scans.handed_in(cut, {"__n": (F.count("*"), F.sum)})
    crossing = cut.select("log_id", scans.PIECE).distinct().count() - 50
    assert 0 < crossing <= 7 and states.where("__n is not null").select("log_id", scans.PIECE).distinct().count() == crossing
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        assert "SortMergeJoin" not in scans.handed_in(cut, {"__n": (F.count("*"), F.sum)})._jdf.queryExecution().sparkPlan().toString()  # no shuffle of the rows for them
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert states.count() == 3000
