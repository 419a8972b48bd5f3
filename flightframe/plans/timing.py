"""Queries: statistics, log times, rates and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.functions import texts
from flightframe.operators import catalog, logs, segments
from flightframe.operators.stats import range_stats
from flightframe.plans.base import FIELDS, SAMPLES, query, rounded, rounded_all
from flightframe.sources.events import event_fields, event_samples

#: Multiplier of the driver's queries: the events have no gap of 20 medians.
GAP = 3.0
LOG = ("log_id",)

_LOGS = """ends as (select log_id, series, arg_min(t, seq) as a, arg_max(t, seq) as b from samples group by all),
logs as (select log_id, min(a) as t_first, max(b) as t_last, greatest(0, max(b) - min(a)) as duration, cast(log_id % 3 as double) as user_offset from ends group by log_id)"""


def dimension(samples: DataFrame) -> DataFrame:
    return logs.log_times(samples).withColumn("user_offset", (F.col("log_id") % 3).cast("double"))


@query(
    "flagship_range_stats",
    f"""with {SAMPLES}, {_LOGS}, moved as (select log_id, series, seq, t - t_first + user_offset as t, v from samples join logs using (log_id))
    select log_id, series, count(*) as n, min(v) as v_min, max(v) as v_max, round(avg(v), 6) + 0.0 as v_mean, round(stddev_pop(v), 6) + 0.0 as v_std, arg_max(v, t) as v_last
    from moved where t between 86400 and 2000000 group by all""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range statistics per log and series in zero-aligned time."""
    samples = event_samples(spark, sf_dir)
    moved = logs.shifted(samples, logs.time_shift(dimension(samples), "on"))
    return rounded_all(range_stats(moved, 86400, 2000000), "v_mean", "v_std")


@query(
    "agg1_stats_with_nan",
    f"""with {SAMPLES}, x as (select log_id, series, seq, t, case when k % 17 = 0 then null else v end as w from samples)
    select log_id, series, count(w) as n, min(w) as v_min, max(w) as v_max, round(avg(w), 6) + 0.0 as v_mean, round(stddev_pop(w), 6) + 0.0 as v_std, arg_max(coalesce(w, -1), struct_pack(t, seq)) as v_last
    from x group by all""",
)
def stats_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir).withColumn("v", F.when(F.col("k") % 17 == 0, F.lit("NaN").cast("double")).otherwise(F.col("v")))
    return rounded_all(range_stats(samples), "v_mean", "v_std").withColumn("v_last", F.nanvl("v_last", F.lit(-1.0)))


@query("cat13_time_range", f"with {SAMPLES} select log_id, series, seq, t, v from samples where t between 1704500000 and 1705500000")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).where(F.col("t").between(1704500000, 1705500000)).select("log_id", "series", "seq", "t", "v")


@query("log1_log_times", f"with {SAMPLES}, {_LOGS} select log_id, t_first, t_last, round(duration, 6) + 0.0 as duration from logs")
def log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(logs.log_times(event_samples(spark, sf_dir)), "duration")


@query("log2_time_shift", f"with {SAMPLES}, {_LOGS} select log_id, case when (select count(*) from logs) > 1 then -t_first else 0 end + user_offset as shift from logs")
def time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.time_shift(dimension(event_samples(spark, sf_dir))).select("log_id", "shift")


@query("log4_labels", f"with {SAMPLES}, {_LOGS} select log_id, 'F' || row_number() over (order by log_id) as label from logs")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.labelled(event_samples(spark, sf_dir).select("log_id").distinct(), "log_id").select("log_id", "label")


@query(
    "log5_mode_source",
    f"""with {SAMPLES}, {_LOGS}, choice as (select log_id as view, log_id as active_id, case log_id % 4 when 0 then 'none' when 1 then 'active' when 2 then cast(log_id + 1 as varchar) else '999999999' end as wanted from logs)
    select view, case when wanted <> 'none' then coalesce(l.log_id, active_id) end as log_id from choice left join logs l on try_cast(wanted as bigint) = l.log_id""",
)
def mode_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = event_samples(spark, sf_dir).select("log_id").distinct()
    wanted = F.element_at(F.array(F.lit("none"), F.lit("active"), (F.col("log_id") + 1).cast("string"), F.lit("999999999")), (F.col("log_id") % 4 + 1).cast("int"))
    return logs.mode_source(every, every.select(F.col("log_id").alias("view"), F.col("log_id").alias("active_id"), wanted.alias("wanted")))


@query("log6_total_duration", f"with {SAMPLES} select log_id, round(max(t) - min(t), 6) + 0.0 as total from samples group by log_id")
def total_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(logs.total_duration(event_samples(spark, sf_dir)), "total")


_STEPS = f"""{SAMPLES}, lagged as (select *, t - lag(t) over w as dt, row_number() over w - 1 as n from samples window w as (partition by log_id, series order by t, seq)),
medians as (select log_id, series, median(dt) filter (dt > 0) as m from lagged group by all), steps as (select * from lagged join medians using (log_id, series))"""
_RATE = """rates as (
    select log_id, series, coalesce(1 / avg(dt) filter (dt > 0 and dt <= greatest(3.0, 5 * m)), 1 / any_value(m), 0) as rate from steps group by all)"""


@query("rate1_effective_rate", f"with {_STEPS}, {_RATE} select log_id, series, round(rate, 12) as rate from rates")
def effective_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.data_rate(event_samples(spark, sf_dir)).withColumn("rate", F.round("rate", 12))


_CATALOG = """named as (select log_id, case series when 'click' then 'ATT' when 'view' then 'GPS' when 'error' then 'IMU' else series end as msg_type, case when series = 'error' then k % 3 end as instance, seq, t from samples),
facts as (select log_id, msg_type, count(*) as n, greatest(1, count(distinct instance)) as i, arg_max(t, seq) - arg_min(t, seq) as span from named group by all),
spans as (select log_id, arg_min(span, list_position(['ATT', 'IMU', 'XKF1', 'POS', 'GPS', 'MODE'], msg_type)) as duration from facts where n > 1 and span > 0 and list_position(['ATT', 'IMU', 'XKF1', 'POS', 'GPS', 'MODE'], msg_type) > 0 group by log_id),
catalog as (select log_id, msg_type, n / i / duration as rate from facts join spans using (log_id) where n > 1)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = F.col("series")
    name = F.when(series == "click", "ATT").when(series == "view", "GPS").when(series == "error", "IMU").otherwise(series)
    return event_samples(spark, sf_dir).select("log_id", name.alias("msg_type"), F.when(series == "error", F.col("k") % 3).alias("instance"), "seq", "t")


@query("rate2_catalog_rate", f"with {SAMPLES}, {_CATALOG} select log_id, msg_type, round(rate, 12) as rate from catalog")
def catalog_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_rates(_messages(spark, sf_dir)).withColumn("rate", F.round("rate", 12))


@query(
    "rate3_rate_lookup",
    f"""with {_STEPS}, {_RATE}, {_CATALOG}, asked as (select log_id, unnest(['ATT.Roll', 'GPS[0]', 'IMU', 'view']) as name from (select distinct log_id from samples))
    select log_id, name, round(coalesce(a.rate, b.rate, c.rate, r.rate, 0), 12) as rate from asked q
    left join catalog a on a.log_id = q.log_id and a.msg_type = name left join catalog b on b.log_id = q.log_id and b.msg_type = split_part(name, '.', 1)
    left join catalog c on c.log_id = q.log_id and c.msg_type = split_part(name, '[', 1) left join rates r on r.log_id = q.log_id and r.series = name""".replace("select log_id, name, round", "select q.log_id, name, round"),
)
def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    asked = samples.select("log_id").distinct().withColumn("name", F.explode(F.array(*map(F.lit, ["ATT.Roll", "GPS[0]", "IMU", "view"]))))
    measured = segments.data_rate(samples).withColumnRenamed("series", "name")
    return catalog.rate_lookup(asked, catalog.catalog_rates(_messages(spark, sf_dir)), measured).withColumn("rate", F.round("rate", 12))


@query(
    "rate4_rate_text",
    f"""with {SAMPLES}, x as (select seq, (v - 5) * (k % 5) as rate from samples)
    select seq, case when rate <= 0 then '0 Hz' when rate >= 100 then printf('%.0f Hz', rate) when rate >= 1 then printf('%.1f Hz', rate) else printf('%.2f Hz', rate) end as text
    from (select seq, round(rate, 2) + 0.001 as rate from x)""",
)
def rate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.round((F.col("v") - 5) * (F.col("k") % 5), 2) + 0.001
    return event_samples(spark, sf_dir).select("seq", texts.rate_text(rate).alias("text"))


def _islands(keys: str, least: float) -> str:
    on = keys
    return f"""{SAMPLES}, lagged as (select *, t - lag(t) over w as dt, row_number() over w - 1 as n from samples window w as (partition by {on} order by t, seq)),
medians as (select {on}, median(dt) filter (dt > 0) as m from lagged group by all),
flagged as (select *, coalesce(dt > greatest({GAP} * m, {least}), false) as gap from lagged join medians using ({on})),
split as (select *, sum(gap::int) over (partition by {on} order by t, seq) as segment from flagged),
firsts as (select *, min(n) over (partition by {on}, segment) as start_n from split),
raw as (select {on}, segment, min(n) as start_idx, max(n) as end_idx, min(t) as start_t, max(t) as end_t, max(t) - min(t) as duration, count(*) as samples,
    any_value(m) as m, median(dt) filter (dt > 0 and n > start_n) as own from firsts group by {on}, segment)"""


_SEG1 = f"""{_islands("log_id, series", 15.0)},
large as (select *, (samples >= 5 or duration >= 1) as big from raw), kept as (select * from (select *, max(big) over (partition by log_id, series) as any_big from large) where big or not any_big),
segs as (select log_id, series, row_number() over (partition by log_id, series order by start_idx) - 1 as idx, start_idx, end_idx, start_t, end_t, duration, samples,
    case when duration > 0 and samples > 1 then (samples - 1) / duration else 0 end as fs,
    row_number() over (partition by log_id, series order by duration desc, samples desc, start_idx) = 1 as is_longest from kept)"""


@query("seg1_gap_segments", f"with {_SEG1} select log_id, series, idx, start_idx, end_idx, start_t, end_t, round(duration, 6) + 0.0 as duration, samples, round(fs, 12) as fs, is_longest from segs")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.gap_segments(event_samples(spark, sf_dir), GAP).withColumns({"duration": rounded("duration"), "fs": F.round("fs", 12)})


_FINE = "case when duration > 0 then (samples - 1) / duration when coalesce(own, m, 0) > 0 then 1 / coalesce(own, m) else 0 end"


@query(
    "seg2_fine_segments",
    f"with {_islands('log_id, series', 0.05)} select log_id, series, segment, start_idx, end_idx, start_t, end_t, round(duration, 6) + 0.0 as duration, samples, round(coalesce(own, m, 0), 6) + 0.0 as median_dt, round({_FINE}, 12) as fs from raw",
)
def fine_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.fine_segments(event_samples(spark, sf_dir), GAP).withColumns({"duration": rounded("duration"), "median_dt": rounded("median_dt"), "fs": F.round("fs", 12)})


_BEST = f"""{_islands("log_id", 0.05)}, ranked as (select *, count(*) over (partition by log_id) as n_segments,
    row_number() over (partition by log_id order by samples > 20 desc, case when samples > 20 then duration else samples end desc, start_idx) as rank from raw)"""


@query(
    "seg3_longest_segment",
    f"with {_BEST} select log_id, segment, start_t, end_t, round(duration, 6) + 0.0 as duration, samples, round(coalesce(own, m, 0), 6) + 0.0 as median_dt, round({_FINE}, 12) as fs, n_segments from ranked where rank = 1",
)
def longest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = segments.longest_segment(event_samples(spark, sf_dir), GAP, keys=LOG, many=20)
    return best.withColumns({"duration": rounded("duration"), "median_dt": rounded("median_dt"), "fs": F.round("fs", 12)}).select("log_id", "segment", "start_t", "end_t", "duration", "samples", "median_dt", "fs", "n_segments")


@query("seg4_robust_rate", f"with {_BEST} select log_id, round({_FINE}, 12) as rate from ranked where rank = 1")
def robust_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.longest_segment(event_samples(spark, sf_dir), GAP, keys=LOG, many=20).select("log_id", F.round("fs", 12).alias("rate"))


@query(
    "seg5_reference_series",
    f"""with {SAMPLES}, x as (select log_id, case when log_id % 2 = 0 and series = 'view' then 'GPS' when log_id % 4 = 0 and series = 'click' then 'ATT' else series end as msg_type, seq from samples),
    c as (select log_id, msg_type, count(*) as n, min(seq) as f from x group by all)
    select log_id, arg_min(msg_type, struct_pack(r := case msg_type when 'ATT' then 1 when 'GPS' then 5 else 99 end, m := case when msg_type in ('ATT', 'GPS') then 0 else -n end, f := f)) as msg_type from c group by log_id""",
)
def reference_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("series")
    name = F.when((F.col("log_id") % 2 == 0) & (s == "view"), "GPS").when((F.col("log_id") % 4 == 0) & (s == "click"), "ATT").otherwise(s)
    return catalog.reference_series(event_samples(spark, sf_dir).select("log_id", name.alias("msg_type"), "seq"))


@query(
    "seg6_segment_filter",
    f"""with {_SEG1}, marked as (select s.log_id, s.series, s.seq, s.t, s.v, coalesce(s.t between g.start_t and g.end_t, false) as inside
        from samples s left join (select * from segs where idx = 1) g on g.log_id = s.log_id and g.series = s.series),
    paired as (select *, max(inside) over (partition by log_id, series) as filtered from marked)
    select log_id, series, seq, t, v, filtered from paired where inside or not filtered""",
)
def segment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    return segments.filter_segment(samples, segments.gap_segments(samples, GAP), "1").select("log_id", "series", "seq", "t", "v", "filtered")


@query(
    "seg7_spectrum_segment",
    f"""with {_islands("log_id, series", 0.05)}, best as (select *, case when m is null then 0 when own > 0 then 1 / own when duration > 0 then (samples - 1) / duration else 0 end as fs,
        row_number() over (partition by log_id, series order by samples desc, start_idx) as rank from raw)
    select s.log_id, s.series, s.seq, s.t, s.v, round(fs, 12) as fs from split s join best b on b.log_id = s.log_id and b.series = s.series and b.segment = s.segment and rank = 1""",
)
def spectrum_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.spectrum_segment(event_samples(spark, sf_dir), GAP).select("log_id", "series", "seq", "t", "v", F.round("fs", 12).alias("fs"))


@query(
    "seg8_display_bounds",
    f"with {_SEG1}, {_LOGS} select series, round(min(start_t - t_first + user_offset), 6) + 0.0 as low, round(max(end_t - t_first + user_offset), 6) + 0.0 as high from segs join logs using (log_id) where is_longest group by series",
)
def display_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    bounds = segments.display_bounds(segments.gap_segments(samples, GAP), logs.time_shift(dimension(samples), "on"), ["series"])
    return rounded_all(bounds, "low", "high")


def _short(x: str) -> str:
    return f"regexp_replace(printf('%.1f', {x}), '\\.0$', '')"


@query(
    "seg9_segment_text",
    f"""with {_SEG1} select log_id, series, idx, 'Segment ' || (idx + 1) || ' (' || {_short("floor(start_t) + 0.01")} || 's ~ ' || {_short("floor(end_t) + 0.26")} || 's, dt=' || {_short("floor(duration) + 0.01")} || 's)' || case when is_longest then ' *' else '' end as text from segs""",
)
def segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.gap_segments(event_samples(spark, sf_dir), GAP)
    text = texts.segment_text(F.col("idx"), F.floor("start_t") + F.lit(0.01), F.floor("end_t") + F.lit(0.26), F.floor("duration") + F.lit(0.01), F.col("is_longest"))
    return found.select("log_id", "series", "idx", text.alias("text"))


@query(
    "log3_aligned_series",
    f"""with {_SEG1}, {_LOGS}, marked as (select s.log_id, s.series, s.seq, s.t, s.v, s.t between g.start_t and g.end_t as inside from samples s join segs g on g.log_id = s.log_id and g.series = s.series and is_longest)
    select log_id, series as name, seq, round(t - t_first + user_offset, 6) + 0.0 as t, v from marked join logs using (log_id) where inside and series in ('click', 'view')""",
)
def aligned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup, then the longest segment, then the shift."""
    samples = event_samples(spark, sf_dir)
    asked = samples.select("log_id").distinct().withColumn("name", F.explode(F.array(F.lit("click"), F.lit("CALC.view")))).withColumn("name", F.col("name"))
    found = logs.lookup(samples, asked).withColumn("series", F.regexp_replace("name", r"^CALC\.", ""))
    cut = segments.filter_segment(found, segments.gap_segments(samples, GAP), "longest")
    return rounded_all(logs.shifted(cut, logs.time_shift(dimension(samples), "on")), "t").select("log_id", F.col("series").alias("name"), "seq", "t", "v")


@query(
    "cat9_series_lookup",
    f"""with {SAMPLES}, {FIELDS}, x as (select log_id, case when field = 'Alt' then 'CALC.' || field else series end as series, seq, t, v from rows),
    asked as (select distinct log_id, n as name from rows, (select unnest(['Alt', 'click.Lat', 'CALC.view.Lng', 'nothing']) as n) q)
    select a.log_id, name, seq, t, v from asked a join x on x.log_id = a.log_id and x.series = case name when 'Alt' then 'CALC.Alt' when 'CALC.view.Lng' then 'view.Lng' else name end""",
)
def series_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_fields(spark, sf_dir).withColumn("series", F.when(F.col("field") == "Alt", F.concat(F.lit("CALC."), "field")).otherwise(F.col("series")))
    asked = rows.select("log_id").distinct().withColumn("name", F.explode(F.array(*map(F.lit, ["Alt", "click.Lat", "CALC.view.Lng", "nothing"]))))
    return logs.lookup(rows, asked)
