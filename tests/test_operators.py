"""Closed-form cases, edge cases and sinks."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flightframe.functions import texts
from flightframe.operators import align, calc, catalog, geo, logs, params, segments, spans, spectrum, stats
from flightframe.sources import csv_logs, sample_store, sinks

SCHEMA = "log_id string, series string, seq long, t double, v double"


def series(spark, *rows):
    """rows: (log, series, times, values)."""
    return spark.createDataFrame([(log, s, i, float(t), None if v is None else float(v)) for log, s, ts, vs in rows for i, (t, v) in enumerate(zip(ts, vs, strict=True))], SCHEMA)


def test_spectrum_of_a_sine_has_its_peak(spark):
    t = np.arange(500) / 100
    df = series(spark, ("a", "x", t, 2.5 * np.sin(2 * np.pi * 15 * t) + 10)).withColumn("fs", F.lit(100.0))
    rows = spectrum.spectrum(df).toPandas()
    peak = rows.loc[rows["mag"].idxmax()]
    assert abs(peak["freq"] - 15) < 0.5 and abs(peak["mag"] - 1.25) < 0.1


def test_spectrum_segment_takes_the_most_samples(spark):
    t = np.concatenate((np.arange(200) / 100, 100 + np.arange(500) / 100))
    rows = segments.spectrum_segment(series(spark, ("a", "x", t, t))).agg(F.min("t"), F.count("*"), F.round(F.max("fs"), 6)).first()
    assert tuple(rows) == (100.0, 500, 100.0)


def test_single_sample_and_empty_series(spark):
    one = series(spark, ("a", "x", [1], [2]))
    assert segments.gap_segments(one).select("samples", "fs", "is_longest").collect() == [(1, 0.0, True)]
    assert segments.data_rate(one).first()["rate"] == 0.0
    assert stats.range_stats(one.limit(0)).count() == 0


def test_vibration_of_a_constant_falls_and_of_a_sine_stays(spark):
    t = np.arange(1000) / 200
    still = calc.vibration(series(spark, ("a", "x", t, np.full(1000, 9.81)))).orderBy("seq").toPandas()
    assert still["v"].iloc[-1] < 0.05
    t = np.arange(2000) / 200
    moving = calc.vibration(series(spark, ("a", "x", t, 9.8 + 3 * np.sin(2 * np.pi * 30 * t)))).orderBy("seq").toPandas()
    assert 1.5 < moving["v"][t > 3].mean() < 2.5 and moving["v"].iloc[0] == 0


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = np.sort(rng.uniform(0, 10, 40)), np.sort(rng.uniform(2, 8, 15))
    y = rng.normal(size=15)
    base = series(spark, ("a", "x", a, a)).select("log_id", "t", "seq")
    got = align.interpolate(base, series(spark, ("a", "y", b, y))).orderBy("seq").toPandas()["other"]
    np.testing.assert_allclose(got, np.interp(a, b, y))


def test_armed_spans_with_open_end_and_short_ones(spark):
    rows = [("a", float(t), i, s) for i, (t, s) in enumerate(zip([0, 10, 20, 30, 40, 50, 100, 200, 250, 300, 300.2, 400], [0, 1, 1, 0, 0, 1, 1, 1, 0, 1, 0, 1]))]
    got = spans.armed_spans(spark.createDataFrame([(k, t, i, bool(s)) for k, t, i, s in rows], "log_id string, t double, seq long, armed boolean")).orderBy("start_t").collect()
    assert [(r.start_t, r.end_t, r.duration) for r in got] == [(10.0, 30.0, 20.0), (50.0, 250.0, 200.0)]


def test_wind_only_while_armed(spark):
    winds = spark.createDataFrame([("a", float(t), i, float(v), "WIND[S1].speed") for i, (t, v) in enumerate(zip([5, 20, 50, 80, 120], [20, 2, 4, 6, 50]))], "log_id string, t double, seq long, speed double, source string")
    flights = spark.createDataFrame([("a", 10.0, 110.0)], "log_id string, start_t double, end_t double")
    assert tuple(spans.wind_stats(winds, flights).select("wind_mean", "wind_max").first()) == (4.0, 6.0)


def test_enu_origin_skips_rows_without_a_fix(spark):
    rows = [("a", float(i), i, *p) for i, p in enumerate([(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (24.0, 121.0, 50.0), (24.001, 121.0, 52.0)])]
    got = geo.series_to_enu(spark.createDataFrame(rows, "log_id string, t double, seq long, lat double, lon double, alt double")).orderBy("seq").collect()
    assert got[0]["E"] is None and got[1]["U"] is None and (got[2]["E"], got[2]["N"], got[2]["U"]) == (0, 0, 0)
    assert abs(got[3]["N"] - 110.8) < 0.2 and got[3]["U"] == 2.0


def test_param_diff_tolerance_text_and_missing(spark):
    rows = [("F1", "ARMING", "1"), ("F1", "BATT", "5000"), ("F1", "RLL", "0.135"), ("F1", "NAN", "NaN"), ("F2", "ARMING", "1.0"), ("F2", "BATT", "5200"), ("F2", "RLL", "0.1350001"), ("F2", "NEW", "42"), ("F2", "NAN", "NaN")]
    df = spark.createDataFrame(rows, "label string, name string, value string")
    assert sorted(r.name for r in params.param_diff(df, ["F1", "F2"], tolerance=1e-5).collect()) == ["BATT", "NEW"]
    assert tuple(params.diff_counts(params.param_diff(df, ["F1", "F2"], False, 1e-5)).first()) == (5, 2)


def test_labels_follow_the_order_over_ranges(spark):
    df = spark.createDataFrame([(k,) for k in (5, 1000, 17, 3)], "n long")
    assert {r.n: r.label for r in logs.labelled(df, "n", 10).collect()} == {3: "F1", 5: "F2", 17: "F3", 1000: "F4"}


def test_texts(spark):
    one = spark.range(1)
    got = one.select(texts.duration_text(F.lit(3723.0)), texts.rate_text(F.lit(0.0)), texts.value_text(F.lit("0.1350001")), texts.value_text(F.lit("1234567.5")), texts.value_text(F.lit("-3.0")), texts.value_text(F.lit('b"ab"')), texts.mode_name(F.lit("99"), F.lit(False))).first()
    assert tuple(got) == ("1h 2m 3s (3723.0 s)", "0 Hz", "0.135", "1.23457e+06", "-3", "ab", "MODE_99")


def test_missing_vector_column_is_an_error(spark):
    with pytest.raises(ValueError):
        calc.vector_magnitude(spark.range(1), ["id", "gone"], "m")


def test_division_by_zero_gives_nan(spark):
    df = series(spark, ("a", "x", [0, 1], [1, 2]), ("a", "y", [0, 1], [0, 2]))
    values = [r.v for r in calc.two_series(df, "x", "/", "y").orderBy("seq").collect()]
    assert math.isnan(values[0]) and values[1] == 1.0
    assert all(math.isnan(r.v) for r in calc.with_constant(df, "x", "/", 0).collect())


def test_instances_need_whole_small_numbers(spark):
    rows = [("a", m, "I", i, float(v)) for m, vs in {"IMU": [0, 0], "PIDR": [0, 1], "XYZ": [0, 0], "ESC": [0, 300]}.items() for i, v in enumerate(vs)]
    got = catalog.instance_columns(spark.createDataFrame(rows, "log_id string, msg_type string, field string, seq long, v double"))
    assert [r.msg_type for r in got.collect()] == ["IMU"]


def test_csv_job_reads_a_directory(spark, tmp_path):
    (tmp_path / "imu_x.csv").write_text("# Start Time: 2026-01-01\nwx,wy,wz,ax,ay,az,time\n" + "".join(f"1,2,3,4,5,6,{572 + i / 200}\n" for i in range(4)) + "# End Time\n")
    (tmp_path / "p.txt").write_text("Parameter,Value\nA,1\nB,x\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "when.csv").write_text("timestamp,val\n,1\n2026-01-01 14:00:00,2\n2026-01-01 14:00:01,3\n")
    job = csv_logs.csv_job(spark, str(tmp_path))
    got = job["samples"].toPandas()
    imu = got[got["msg_type"] == "IMU"]
    assert set(imu["field"]) == {"wx", "wy", "wz", "ax", "ay", "az"} and len(imu) == 24 and imu["t"].max() == 572.015
    assert sorted(got[got["msg_type"] == "WHEN"]["t"]) == [0.0, 0.0, 1.0]
    assert {(r.name, r.value) for r in job["params"].collect()} == {("Start_Time", "2026-01-01"), ("A", "1"), ("B", "x")}


def test_wide_export_of_several_logs(spark, tmp_path):
    df = series(spark, ("1", "ATT.Roll", [10, 11, 12], [1, 2, 3]), ("2", "ATT.Roll", [0.5, 1], [10, 20]), ("2", "ATT.Yaw", [0.5], [7]), ("2", "GPS.Alt", [9], [9]))
    dim = spark.createDataFrame([("1", "F1", -10.0), ("2", "F2", 0.0)], "log_id string, label string, shift double")
    asked = spark.createDataFrame([("1", "ATT.Roll"), ("2", "ATT.Roll"), ("2", "ATT.Roll"), ("2", "none")], "log_id string, series string")
    wide = sinks.wide_export(df, dim, asked)
    assert wide.columns == ["timestamp", "F1.ATT.Roll", "F2.ATT.Roll"]
    assert [tuple(r) for r in wide.orderBy("timestamp").collect()] == [(0, 1, None), (0.5, None, 10), (1, 2, 20), (2, 3, None)]
    filled = sinks.wide_export(df, dim, asked, fill="ffill", low=0.5, high=1.0)
    assert [tuple(r) for r in filled.orderBy("timestamp").collect()] == [(0.5, None, 10), (1, 2, 20)]
    assert sinks.wide_export(df, dim, asked, scope="messages").columns == ["timestamp", "F1.ATT.Roll", "F2.ATT.Roll", "F2.ATT.Yaw"]
    one = sinks.wide_export(df, dim.where("label = 'F2'"), asked)
    assert one.columns == ["timestamp", "ATT.Roll"] and one.count() == 2
    assert sinks.wide_export(df, dim, asked.where("series = 'none'")).count() == 0
    assert sinks.write_csv(wide, str(tmp_path / "out.csv"), 3) == 4
    assert (tmp_path / "out.csv").read_text() == "timestamp,F1.ATT.Roll,F2.ATT.Roll\n0.0,1.0,\n0.5,,10.0\n1.0,2.0,20.0\n2.0,3.0,\n"
    assert sinks.write_csv(wide.limit(0), str(tmp_path / "none.csv")) == 0
    assert (tmp_path / "none.csv").read_text() == "timestamp,F1.ATT.Roll,F2.ATT.Roll\n"
    with pytest.raises(FileExistsError):
        sinks.write_csv(wide, str(tmp_path / "out.csv"))
    assert sinks.export_csv(df, dim, asked, str(tmp_path / "lines.csv"), parts=3) == 4
    assert (tmp_path / "lines.csv").read_text() == (tmp_path / "out.csv").read_text()
    assert sinks.export_csv(df, dim, asked, str(tmp_path / "filled.csv"), fill="ffill", parts=3) == 4
    assert (tmp_path / "filled.csv").read_text().split()[1:] == ["0.0,1.0,", "0.5,1.0,10.0", "1.0,2.0,20.0", "2.0,3.0,20.0"]
    assert sinks.export_csv(df, dim, asked.where("series = 'none'"), str(tmp_path / "no.csv")) == 0
    assert (tmp_path / "no.csv").read_text() == "timestamp\n"
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["filled.csv", "lines.csv", "no.csv", "none.csv", "out.csv"]


def test_export_is_one_file_in_order_of_time(spark, tmp_path):
    rng = np.random.default_rng(9)
    df = series(spark, *((f"{log}", f"A.{name}", np.round(rng.exponential(1, 60).cumsum() ** 3, 2).tolist(), rng.normal(size=60).tolist()) for log in range(12) for name in "xyz"))
    dim = spark.createDataFrame([(f"{log}", f"F{log + 1}", -0.5 * log) for log in range(12)], "log_id string, label string, shift double")
    asked = df.select("log_id", "series")
    wide = sinks.wide_export(df, dim, asked, fill="ffill").toPandas().sort_values("timestamp", ignore_index=True)
    for fill in ("none", "ffill"):
        assert sinks.export_csv(df, dim, asked, str(tmp_path / f"{fill}.csv"), fill=fill, parts=11) == len(wide)
        lines = (tmp_path / f"{fill}.csv").read_text().splitlines()
        times = [float(line.split(",", 1)[0]) for line in lines[1:]]
        assert times == sorted(times) and sum(line.startswith("timestamp") for line in lines) == 1 and {line.count(",") for line in lines} == {36}
    pd.testing.assert_frame_equal(pd.read_csv(tmp_path / "ffill.csv"), wide[["timestamp", *sorted(wide.columns[1:])]], check_dtype=False)


def test_export_of_twenty_thousand_columns(spark, tmp_path):
    n = 20_000
    df = spark.range(n).selectExpr("cast(id as string) as log_id", "'A.x' as series", "id as seq", "double(id % 40) as t", "double(id) as v")
    dim = spark.range(n).selectExpr("cast(id as string) as log_id", "concat('F', id) as label", "0d as shift")
    for fill, cells in (("none", n), ("ffill", sum(n - k * n // 40 for k in range(40)))):
        assert sinks.export_csv(df, dim, df.select("log_id", "series"), str(tmp_path / f"{fill}.csv"), fill=fill, parts=5) == 40
        lines = (tmp_path / f"{fill}.csv").read_text().splitlines()
        assert len(lines) == 41 and {line.count(",") for line in lines} == {n}
        assert sum(sum(x != "" for x in line.split(",")[1:]) for line in lines[1:]) == cells


def test_wide_export_takes_equal_times_as_they_are(spark):
    times = [0.00000012, 0.00000014, 2]
    df = series(spark, ("1", "A.x", times, [1, 2, 3]), ("1", "A.y", times, [4, 5, 6]))
    dim = spark.createDataFrame([("1", "F1", 0.0)], "log_id string, label string, shift double")
    wide = sinks.wide_export(df, dim, df.select("log_id", "series"))
    assert sorted(tuple(r) for r in wide.collect()) == [(times[0], 1, 4), (times[1], 2, 5), (2, 3, 6)]


def test_wide_export_of_the_longest_segment(spark):
    df = series(spark, ("1", "A.x", [*range(10), *range(100, 130)], range(40)))
    dim = spark.createDataFrame([("1", "F1", -100.0)], "log_id string, label string, shift double")
    assert [r.timestamp for r in sinks.wide_export(df, dim, df.select("log_id", "series"), segment="longest").orderBy("timestamp").collect()] == list(range(30))


def test_forward_fill_hands_values_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(float(t), *(float(x) if rng.random() < 0.1 else (math.nan if rng.random() < 0.1 else None) for x in rng.normal(size=2))) for t in np.cumsum(rng.exponential(size=300) ** 4)]
    got = sinks.forward_filled(spark.createDataFrame(rows, "timestamp double, a double, `b.c` double"), ["a", "b.c"], 16).orderBy("timestamp").collect()
    last = [None, None]
    for r, row in zip(got, rows, strict=True):
        last = [old if new is None or math.isnan(new) else new for old, new in zip(last, row[1:])]
        assert tuple(r) == (row[0], *last)


def test_labels_in_ranges(spark):
    ids = [5, -3, 7, 1 << 50, 12, 9]
    got = {r.log_id: r.label for r in logs.labelled(spark.createDataFrame([(k,) for k in ids], "log_id long"), "log_id", 3).collect()}
    assert got == {k: f"F{n}" for n, k in enumerate(sorted(ids), 1)}


def test_vibration_goes_on_over_batches(spark):
    rng = np.random.default_rng(6)
    sizes = [700, 1, 2, 350, 3]
    rows = [(f"l{k}", "x", np.cumsum(rng.exponential(0.02, n)), rng.normal(size=n)) for k, n in enumerate(sizes)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = calc.vibration(series(spark, *rows)).orderBy("log_id", "seq").toPandas()
        bins = spectrum.spectrum(series(spark, *rows).withColumn("fs", F.lit(8.0))).orderBy("log_id", "bin").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for log, _, t, y in rows:
        level, state, expected = y[0], 0.0, [0.0]
        for k in range(1, len(y)):
            dt = max(t[k] - t[k - 1], 1e-6)
            level += dt / (dt + 1 / (10 * np.pi)) * (y[k] - level)
            square = (y[k] - level) ** 2
            state = square if k == 1 else state + dt / (dt + 1 / (4 * np.pi)) * (square - state)
            expected.append(state**0.5)
        np.testing.assert_allclose(got.loc[got.log_id == log, "v"], expected, rtol=1e-9, atol=1e-12)
        mine, n = bins[bins.log_id == log], len(y)
        if n > 1:
            np.testing.assert_allclose(mine["freq"], np.fft.rfftfreq(n, 1 / 8))
            np.testing.assert_allclose(mine["mag"], np.abs(np.fft.rfft((y - y.mean()) * np.hanning(n))) * 2 / n, atol=1e-9)
        else:
            assert mine["mag"].tolist() == [0.0]


def test_mode_names_of_odd_texts(spark):
    df = spark.createDataFrame([("99999999999",), ("007",), (" 5 ",), ("guided/x",), (None,)], "mode string")
    got = [r[0] for r in df.select(texts.mode_name(F.col("mode"), F.lit(True))).collect()]
    assert got == ["MODE_99999999999", texts.COPTER_MODES[7], texts.COPTER_MODES[5], "GUIDED", None]


def test_armed_sources_in_order(spark):
    def rows(log, message, field, values):
        return [(log, message, field, k, float(k), float(v)) for k, v in enumerate(values)]

    data = rows("a", "HEARTBEAT[S255]", "base_mode", [128, 128, 0]) + rows("a", "HEARTBEAT[S1]", "base_mode", [0, 200, 81, 0]) + rows("a", "HEARTBEAT", "base_mode", [128, 128])
    data += rows("b", "HEARTBEAT[S1]", "base_mode", [0, 1]) + rows("b", "STAT", "ArmState", [1, 1]) + rows("b", "STAT", "Arm", [0, -1, 0.9, 2, 2, 0])
    data += rows("c", "STAT", "Other", [1, 1]) + rows("c", "EV", "Event", [10, 10, 10]) + [("c", "EV", "Id", 0, 1.0, 10.0), ("c", "EV", "Id", 1, 4.0, 11.5)]
    data += [("d", "EV[1]", "Event", 0, 2.0, 10.0), ("d", "EV[1]", "Event", 1, 9.0, 3.0), ("d", "EV", "Id", 0, 5.0, 11.0), ("d", "EV", "Id", 1, 5.2, 10.0), ("d", "EV", "Id", 2, 5.4, 0.0)]
    fields = spark.createDataFrame(data, "log_id string, msg_type string, field string, seq long, t double, v double")
    got = sorted(tuple(r) for r in spans.all_armed_spans(fields).select("log_id", "source", "start_t", "end_t").collect())
    # of log d the first message has no span of over half a second
    assert got == [("a", "HEARTBEAT[S1].base_mode", 1.0, 2.0), ("b", "STAT.Armed", 3.0, 5.0), ("c", "EV.Id (10/11)", 1.0, 4.0), ("d", "EV[1].Id (10/11)", 2.0, 9.0)]


@pytest.mark.parametrize(
    ("fields", "source"),
    [
        (["WIND.WS", "WIND[S1].speed"], "WIND.WS"),
        (["WIND[S1].VelN", "WIND[S1].VelE", "WIND[S2].speed"], "WIND[S1].VelN/VelE"),
        (["WIND[0].speed", "AHR2.wind_vel"], "AHR2.wind_vel"),
        (["WIND[0].speed"], None),
        (["XKF2[1].VWN", "XKF2[1].VWE", "XKF2[0].VWN", "XKF2[0].VWE", "NKF2.VWN"], "XKF2[0].VWN/VWE"),
        (["AHR2.wind_spd", "AHR2[S1].wind_speed"], "AHR2[S1].wind_speed"),
        (["WIND_COV[S1].wind_x", "WIND_COV[S1].wind_y", "AHR2.wind_spd"], "WIND_COV[S1].wind_x/wind_y"),
        (["WIND_COV[S2].wind_x", "WIND_COV[S2].wind_y"], None),
        (["XKF2B.VWN", "XKF2B.VWE"], None),
    ],
)
def test_wind_sources_by_message_with_its_instance(spark, fields, source):
    rows = [(1, *name.split("."), 0, 0.0, 3.0) for name in fields]
    got = spans.wind_speeds(spark.createDataFrame(rows, "log_id long, msg_type string, field string, seq long, t double, v double")).collect()
    assert [(r.source, round(r.speed, 9)) for r in got] == ([(source, round(math.sqrt(18), 9) if "/" in source else 3.0)] if source else [])


def test_first_spans_and_ends_of_modes(spark):
    modes = spark.createDataFrame([(log, kind, True, float(t), t, m, 50.0) for log, kind in (("a", "binary"), ("b", "text"), ("c", "link")) for t, m in ((1, "5"), (60, "3"))], "log_id string, kind string, copter boolean, t double, seq long, mode string, log_end double")
    found = spans.log_mode_spans(modes)
    got = sorted((r.log_id, r.name, r.end_t) for r in found.where("start_t = 60").collect())
    assert got == [("a", texts.COPTER_MODES[3], 61.0), ("b", "3", 61.0), ("c", "3", 70.0)]
    assert [r.start_t for r in spans.first_spans(found, 1).collect()] == [1.0] * 3


def test_segment_filter_falls_back_to_everything(spark):
    df = series(spark, ("a", "x", range(10), range(10)))
    rows = segments.filter_segment(df, segments.gap_segments(df), "7")
    assert rows.count() == 10 and not rows.first()["filtered"]


def test_csv_job_numbers_a_file_over_pieces_and_reads_it_once(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n" + "".join(f"{k},{k % 7}\n" for k in range(5000)))
    (tmp_path / "short.csv").write_text("a,b\n1,2\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c, v in zip(before, ("11", "8k", "1k"), strict=True):
            spark.conf.set(c, v)
        samples = csv_logs.csv_job(spark, str(tmp_path))["samples"].where("field = 'a'")
        plan = samples._jdf.queryExecution().executedPlan().toString()
        got = samples.select("msg_type", "t", "v").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((r.t, r.v) for r in got if r.msg_type == "LONG") == [(pytest.approx(k * 0.1), float(k)) for k in range(5000)]
    assert [(r.t, r.v) for r in got if r.msg_type == "SHORT"] == [(0.0, 1.0)]
    assert "long.csv" not in plan and "Scan text" not in plan  # lines and rows come from the stored tables


def test_group_names(spark):
    cases = [("x_IMU.csv", ["a"], "IMU"), ("q.csv", ["WX", "b", "ay"], "IMU"), ("q.csv", ["wx2", "ay"], "Q"), ("begins.csv", ["a"], "INS"), ("a.csv", ["Latitude", "lng"], "GPS"), ("a.csv", ["Roll", "pitch_deg"], "ATT")]
    cases += [("b.csv", ["Pressure"], "BARO"), ("image.csv", ["a"], "MAG"), ("magnet.csv", ["a"], "MAG"), ("z.csv", ["Tick"], "DJI"), ("my-log_20260917_143651.csv", ["a"], "MY_LOG"), ("run-2026-09-17.csv", ["a"], "RUN"), ("123.csv", ["a"], "CSV"), (f"{'n' * 21}.csv", ["a"], "CSV"), ("-.csv", ["a"], "CSV")]
    df = spark.createDataFrame([(k, f, n) for k, (f, n, _) in enumerate(cases)], "k long, f string, n array<string>")
    assert [r.g for r in df.select("k", csv_logs.group_name(F.col("f"), F.col("n")).alias("g")).orderBy("k").collect()] == [g for *_, g in cases]


def test_store_reads_only_what_is_asked_for(spark, tmp_path):
    rows = [(log, m, f, k, k / 10, float(k)) for log in ("1", "2", "3") for m in ("GPS[0]", "007", "ATT", None) for f in ("a", "b") for k in range(200)]
    df = spark.createDataFrame(rows, "log_id string, msg_type string, field string, seq long, t double, v double")
    path = str(tmp_path / "store")
    sample_store.write_store(df, path, 9)
    back = sample_store.read_store(spark, path)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    some = sample_store.read_store(spark, path, ["007"], ["2"], 5.0, 6.0)
    assert sorted((r.log_id, r.msg_type, r.t) for r in some.where("field = 'a'").collect()) == [("2", "007", k / 10) for k in range(50, 61)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "msg_type" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(t,5.0)" in plan and "LessThanOrEqual(t" in plan
    assert {(r.msg_type, r.log_id, r.field, r.n, r.t_last) for r in sample_store.catalog(spark, path).collect()} == {(m, log, f, 200, 19.9) for m in ("GPS[0]", "007", "ATT", None) for log in "123" for f in "ab"}
    sample_store.write_store(df.limit(0), str(tmp_path / "none"))
    assert sample_store.catalog(spark, str(tmp_path / "none")).count() == 0


def test_log_summary_holds_few_sorts_in_one_plan(spark):
    samples = spark.createDataFrame([(log, "view", 10 * log + k, float(k), 1.0 + k) for log in range(4) for k in range(6)], "log_id long, series string, seq long, t double, v double")
    fields = samples.select("log_id", F.lit("STAT").alias("msg_type"), F.lit("Armed").alias("field"), "seq", "t", (F.col("seq") % 5 - 1).cast("double").alias("v"))
    winds = fields.withColumns({"msg_type": F.lit("WIND"), "field": F.lit("speed"), "v": F.lit(3.0)})
    summary = spans.log_summary(samples, spans.all_armed_spans(fields), spans.wind_speeds(winds))
    plan = summary._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 2  # what comes before is stored
    assert [(r.log_id, r.duration, r.arming_source, r.flights, r.wind_mean) for r in summary.orderBy("log_id").collect()] == [(log, 5.0, "STAT.Armed", 1, 3.0) for log in range(4)]


def test_export_to_files_grows_with_the_cells(spark, tmp_path):
    """Every log has times of its own: one file needs a separator for each time and column, the files one for each cell and column of a file."""
    df = spark.range(1200).select((F.col("id") % 60).alias("log_id"), F.lit("a").alias("series"), F.col("id").alias("seq"), (F.col("id") / 4).alias("t"), F.when(F.col("id") % 7 > 0, F.col("id") / 8).alias("v"))
    dim = spark.range(60).select(F.col("id").alias("log_id"), F.format_string("F%02d", "id").alias("label"), F.lit(0.0).alias("shift"))
    for fill in ("none", "ffill"):
        assert sinks.export_csv(df, dim, df.select("log_id", "series"), str(tmp_path / f"{fill}.csv"), fill=fill, parts=5) == 1200
        assert sinks.export_files(df, dim, df.select("log_id", "series"), str(tmp_path / fill), fill=fill, parts=5, width=7) == 1200
        whole = pd.read_csv(tmp_path / f"{fill}.csv").melt("timestamp", var_name="column", value_name="v").dropna().sort_values(["timestamp", "column"], ignore_index=True)
        found = sinks.read_files(spark, str(tmp_path / fill)).toPandas().sort_values(["timestamp", "column"], ignore_index=True)
        pd.testing.assert_frame_equal(found, whole, check_dtype=False)
        for k in range(9):
            lines = "".join(gzip.decompress(f.read_bytes()).decode() for f in sorted((tmp_path / fill / f"file={k}").glob("*.gz"))).splitlines()
            assert lines[0] == "timestamp," + ",".join(f"F{c:02d}.a" for c in range(7 * k, min(7 * k + 7, 60)))
            times = [float(line.split(",")[0]) for line in lines[1:]]
            assert times == sorted(times) and len(times) == (1200 if fill == "ffill" else 20 * min(7, 60 - 7 * k))
            assert all(line.count(",") == min(7, 60 - 7 * k) for line in lines)
    assert sinks.export_files(df, dim, df.where("log_id < 0").select("log_id", "series"), str(tmp_path / "no"), width=7) == 0
    assert sinks.read_files(spark, str(tmp_path / "no")).count() == 0


def test_filled_files_carry_values_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK", 16)
    monkeypatch.setattr(sinks, "LINES", 5)
    test_export_to_files_grows_with_the_cells(spark, tmp_path)


def test_export_to_files_takes_equal_times_as_they_are(spark, tmp_path):
    df = spark.createDataFrame([(log, "a", 10 * log + k, 0.1234567 * (k // 2), float(k)) for log in (1, 2, 3) for k in range(4)], "log_id long, series string, seq long, t double, v double")
    dim = spark.createDataFrame([(log, f"F{log}", 0.0) for log in (1, 2, 3)], "log_id long, label string, shift double")
    assert sinks.export_files(df, dim, df.select("log_id", "series"), str(tmp_path / "equal"), fill="ffill", width=2) == 4
    rows = sinks.read_files(spark, str(tmp_path / "equal")).orderBy("column", "timestamp", "v").collect()
    assert [tuple(r) for r in rows] == [(t, f"F{log}.a", v) for log in (1, 2, 3) for t, v in ((0.0, 0.0), (0.0, 1.0), (0.1234567, 2.0), (0.1234567, 3.0))]
