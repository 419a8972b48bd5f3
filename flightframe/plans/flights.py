"""Queries: mode and armed spans, winds, summaries, parameters and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightframe.functions import texts
from flightframe.operators import params, spans
from flightframe.plans.base import SAMPLES, query, rounded_all
from flightframe.sources.events import event_samples
from flightframe.sources.store import stored

_MODES = "modes as (select log_id, t, seq, cast(k % 30 as varchar) as mode, ['binary', 'text', 'link'][log_id % 3 + 1] as kind, log_id % 2 = 0 as copter, e from samples join (select log_id, max(t) as e from samples group by log_id) using (log_id) where series = 'click')"


def _cases(names: dict[int, str]) -> str:
    return "case n " + " ".join(f"when {n} then '{name}'" for n, name in names.items()) + " else 'MODE_' || n end"


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode messages: of each log's kind, in the table of its vehicle."""
    samples = event_samples(spark, sf_dir).withColumn("log_end", F.max("t").over(Window.partitionBy("log_id")))
    kind = F.element_at(F.array(*map(F.lit, ["binary", "text", "link"])), (F.col("log_id") % 3 + 1).cast("int"))
    return samples.where("series = 'click'").select("log_id", kind.alias("kind"), (F.col("log_id") % 2 == 0).alias("copter"), "t", "seq", (F.col("k") % 30).cast("string").alias("mode"), "log_end")


@query(
    "win1_mode_spans",
    f"""with {SAMPLES}, {_MODES}, named as (select *, cast(mode as int) as n from modes)
    select log_id, case when kind <> 'binary' then mode when copter then {_cases(texts.COPTER_MODES)} else {_cases(texts.PLANE_MODES)} end as name, t as start_t,
        coalesce(lead(t) over (partition by log_id order by t, seq), case when kind = 'link' then t + 10 else greatest(e, t + 1) end) as end_t from named""",
)
def mode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.log_mode_spans(_modes(spark, sf_dir))


@query("top2_first_mode_spans", f"with {SAMPLES}, {_MODES} select log_id, name, start_t from (select log_id, mode as name, t as start_t, row_number() over (partition by log_id order by t, seq) as n from modes) where n <= 100")
def first_mode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 spans of each log in order (a report of a fixed length per log)."""
    modes = _modes(spark, sf_dir).withColumnRenamed("mode", "name")
    return spans.first_spans(spans.mode_spans(modes, F.col("t") + 10)).select("log_id", "name", "start_t")


@query(
    "win2_mode_changes",
    f"""with {SAMPLES}, h as (select log_id, 1 + seq % 2 as sysid, t, seq, case when k % 7 = 0 then 'Mode(' || k || ')' else 'M' || (k % 3) end as mode from samples),
    x as (select *, lag(mode) over (partition by log_id order by t, seq) as b from h where sysid = 1 and not starts_with(mode, 'Mode(')) select log_id, t, seq, mode from x where b is null or b <> mode""",
)
def mode_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("k") % 7 == 0, F.concat(F.lit("Mode("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("M"), (F.col("k") % 3).cast("string")))
    beats = event_samples(spark, sf_dir).select("log_id", (1 + F.col("seq") % 2).alias("sysid"), "t", "seq", mode.alias("mode"))
    return spans.mode_changes(beats).select("log_id", "t", "seq", "mode")


def armed_sql(name: str, source: str) -> str:
    """CTEs from source(log_id, source, rank, t, seq, armed) to name(log_id, source, rank, start_t, end_t, duration)."""
    return f"""{name}_e as (select *, armed and not coalesce(lag(armed) over w, false) as edge, coalesce(lead(t) over w, t) as next_t from {source} window w as (partition by log_id, source order by t, seq)),
{name}_r as (select *, sum(edge::int) over (partition by log_id, source order by t, seq) as run from {name}_e),
{name} as (select *, end_t - start_t as duration from (select log_id, source, rank, min(t) as start_t, max(next_t) as end_t from {name}_r where armed group by log_id, source, rank, run) where end_t - start_t > 0.5)"""


#: Messages of the samples: heartbeats of several systems, states under several names, and others.
_MESSAGES = """messages as (select log_id, t, seq, case when k % 10 < 4 then ['HEARTBEAT', 'HEARTBEAT[S1]', 'HEARTBEAT[S255]', 'HEARTBEAT[S1]'][k % 10 + 1] when k % 10 < 7 then ['STAT', 'STAT[1]'][k % 2 + 1] else 'OTHER' end as msg_type,
    case when k % 10 < 4 then 'base_mode' else ['Armed', 'Arm', 'ArmState', 'Other'][cast(len(series) % 4 as int) + 1] end as field, case when k % 10 < 4 then v * 8 else (k % 3 - 1) * 1.5 end as v from samples)"""
_BEATS = "beats as (select log_id, t, seq, msg_type || '.base_mode' as source, case when contains(msg_type, '[S1]') then 0 when contains(msg_type, '[S') then 1 else 2 end as rank, cast(trunc(v) as bigint) & 128 <> 0 as armed from messages where starts_with(msg_type, 'HEARTBEAT'))"
_STATS = """stat_rows as (select *, case field when 'Armed' then 1 when 'Arm' then 2 else 3 end as place from messages where starts_with(msg_type, 'STAT') and field <> 'Other'),
stats as (select log_id, t, seq, msg_type || '.Armed' as source, 0 as rank, trunc(v) > 0 as armed from (select *, min(place) over (partition by log_id, msg_type) as first from stat_rows) where place = first)"""
_EVENTS = "evs as (select log_id, t, case series when 'click' then 10 when 'error' then 11 else 0 end as id from samples)"
_EVENT_SPANS = """event_spans as (select log_id, start_t, end_t, end_t - start_t as duration from (
    select a.log_id, a.t as start_t, coalesce((select min(d.t) from evs d where d.log_id = a.log_id and d.id = 11 and d.t > a.t), (select max(d.t) from evs d where d.log_id = a.log_id)) as end_t from evs a where a.id = 10) where end_t - start_t > 0.5)"""


def _messages(samples: DataFrame) -> DataFrame:
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    ten, beat = F.col("k") % 10, F.col("k") % 10 < 4
    message = F.when(beat, pick(["HEARTBEAT", "HEARTBEAT[S1]", "HEARTBEAT[S255]", "HEARTBEAT[S1]"], F.least(ten, F.lit(3)))).when(ten < 7, pick(["STAT", "STAT[1]"], F.col("k") % 2)).otherwise("OTHER")
    field = F.when(beat, "base_mode").otherwise(pick([*spans.STATE_FIELDS, "Other"], F.length("series") % 4))
    return samples.select("log_id", message.alias("msg_type"), field.alias("field"), "seq", "t", F.when(beat, F.col("v") * 8).otherwise((F.col("k") % 3 - 1) * 1.5).alias("v"))


def _events(samples: DataFrame) -> DataFrame:
    return samples.select("log_id", "t", F.when(F.col("series") == "click", spans.ARM).when(F.col("series") == "error", spans.DISARM).otherwise(0).alias("id"))


_SPAN = "log_id, start_t, end_t, round(duration, 6) + 0.0 as duration"


@query("win3_heartbeat_spans", f"with {SAMPLES}, {_MESSAGES}, {_BEATS}, {armed_sql('found', 'beats')} select {_SPAN}, source from (select *, min(struct_pack(rank, source)) over (partition by log_id) as best from found) where best = struct_pack(rank, source)")
def heartbeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(spans.first_source(spans.heartbeat_spans(_messages(event_samples(spark, sf_dir)))), "duration")


@query("win4_state_spans", f"with {SAMPLES}, {_MESSAGES}, {_STATS}, {armed_sql('found', 'stats')} select {_SPAN}, source from (select *, min(source) over (partition by log_id) as best from found) where best = source")
def state_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(spans.first_source(spans.state_spans(_messages(event_samples(spark, sf_dir)))), "duration")


@query("win5_event_spans", f"with {SAMPLES}, {_EVENTS}, {_EVENT_SPANS} select {_SPAN} from event_spans")
def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(spans.event_spans(_events(event_samples(spark, sf_dir))), "duration")


@query("join8_next_disarming", f"with {SAMPLES}, {_EVENTS}, {_EVENT_SPANS} select log_id, start_t, end_t from event_spans")
def next_disarming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.event_spans(_events(event_samples(spark, sf_dir))).select("log_id", "start_t", "end_t")


#: What a log has follows from the greatest k of its samples.
_FACTS = "facts as (select *, max(k) over (partition by log_id) as most from samples)"
#: Events in two messages; of one of them some logs have the number in Id, beside an Event of another meaning, the others in Event.
_EV = """ev as (select log_id, t, case when k % 3 > 0 then 'EV.Id (10/11)' else 'EV[1].Id (10/11)' end as source, 0 as rank, case series when 'click' then 10 when 'error' then 11 else 0 end as id from facts where series <> 'purchase'),
ev_spans as (select log_id, source, rank, start_t, end_t, end_t - start_t as duration from (
    select a.log_id, a.source, a.rank, a.t as start_t, coalesce((select min(d.t) from ev d where d.log_id = a.log_id and d.source = a.source and d.id = 11 and d.t > a.t), (select max(d.t) from ev d where d.log_id = a.log_id and d.source = a.source)) as end_t from ev a where a.id = 10) where end_t - start_t > 0.5)"""


def _event_fields(samples: DataFrame) -> DataFrame:
    facts = samples.withColumn("most", F.max("k").over(Window.partitionBy("log_id"))).where("series <> 'purchase'")
    number = F.when(F.col("series") == "click", spans.ARM).when(F.col("series") == "error", spans.DISARM).otherwise(0) + F.lit(0.25)
    first = F.col("k") % 3 > 0
    cell = lambda field, v: F.struct(F.lit(field).alias("field"), v.cast("double").alias("v"))
    cells = F.when(first & (F.col("most") % 2 == 0), F.array(cell("Event", F.lit(10)), cell("Id", number))).otherwise(F.array(cell("Event", number)))
    return facts.select("log_id", F.when(first, "EV").otherwise("EV[1]").alias("msg_type"), "seq", "t", F.explode(cells).alias("c")).select("log_id", "msg_type", "c.field", "seq", "t", "c.v")


@query("win5_event_messages", f"with {SAMPLES}, {_FACTS}, {_EV} select {_SPAN}, source from (select *, min(source) over (partition by log_id) as best from ev_spans) where best = source")
def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(spans.first_source(spans.event_message_spans(_event_fields(event_samples(spark, sf_dir)))), "duration")


#: A third of the logs has heartbeats, states and events, another no heartbeats, another only events.
_ALL = f"""{SAMPLES}, {_FACTS}, {_MESSAGES}, {_BEATS}, {armed_sql('hb', 'beats')}, {_STATS}, {armed_sql('st', 'stats')}, {_EV},
every as (select log_id, start_t, end_t, duration, source, struct_pack(kind := 0, rank, source) as place from hb where log_id in (select log_id from facts where most % 3 = 0)
    union all by name select log_id, start_t, end_t, duration, source, struct_pack(kind := 1, rank, source) as place from st where log_id in (select log_id from facts where most % 3 < 2)
    union all by name select log_id, start_t, end_t, duration, source, struct_pack(kind := 2, rank, source) as place from ev_spans),
spans as (select * from (select *, min(place) over (partition by log_id) as best from every) where place = best)"""


def _stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples for queries that read them many times."""
    return stored(event_samples(spark, sf_dir), "samples")


def all_spans(samples: DataFrame) -> DataFrame:
    most = samples.groupBy("log_id").agg(F.max("k").alias("most"))
    told = _messages(samples).join(most, "log_id").where("(most % 3 = 0 or not startswith(msg_type, 'HEARTBEAT')) and (most % 3 < 2 or not startswith(msg_type, 'STAT'))").drop("most")
    return spans.all_armed_spans(told.unionByName(_event_fields(samples)))


@query("win6_source_precedence", f"with {_ALL} select {_SPAN}, source from spans")
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(all_spans(_stored_samples(spark, sf_dir)), "duration")


#: By the greatest k of a log: messages and fields with its wind, and others that do not count beside them.
WINDS = [
    (["WIND.WS"], ["WIND[S1].speed", "WIND[0].speed"]),
    (["XKF2[0].VWN", "XKF2[0].VWE"], ["WIND[0].speed", "XKF2[1].VWN", "XKF2[1].VWE", "EKF3.VWN", "EKF3.VWE"]),
    (["AHR2[S1].wind_speed"], ["AHR2.wind_vel", "AHR2[S2].wind_spd"]),
    (["WIND_COV[S1].wind_x", "WIND_COV[S1].wind_y"], ["WIND_COV[S2].wind_x", "WIND_COV[S2].wind_y", "AHR2.wind_spd"]),
    (["EKF3.VWN", "EKF3.VWE"], ["NKF2.VWN", "WIND.Other", "WIND_COV.wind_x"]),
    (["WIND[S2].VelN", "WIND[S2].VelE"], ["NKF2.VWN", "NKF2.VWE"]),
]
_SOURCE = " ".join(f"when {k} then '{'/'.join([good[0], *(g.split('.')[1] for g in good[1:])])}'" for k, (good, _) in enumerate(WINDS))
_WINDS = f"""wind_rows as (select s.log_id, seq, t, most % {len(WINDS)} as kind, v - 5 as v from samples s join (select log_id, max(k) as most from samples group by log_id) using (log_id) where series = 'view' and k % 7 <> 0),
winds as (select log_id, seq, t, case when kind in ({", ".join(str(k) for k, (good, _) in enumerate(WINDS) if len(good) == 2)}) then sqrt(v * v + v * v) else v end as speed, case kind {_SOURCE} end as source from wind_rows)"""


def wind_fields(samples: DataFrame) -> DataFrame:
    most = samples.groupBy("log_id").agg((F.max("k") % len(WINDS)).alias("kind"))
    rows = samples.where("series = 'view' and k % 7 <> 0").join(most, "log_id")
    cells = F.lit(None).cast("array<struct<name:string,good:boolean>>")
    for k, (good, others) in enumerate(WINDS):
        every = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(is_good).alias("good")) for names, is_good in ((good, True), (others, False)) for n in names))
        cells = F.when(F.col("kind") == k, every).otherwise(cells)
    named = rows.select("log_id", "seq", "t", "v", F.explode(cells).alias("c"))
    part = lambda i: F.split("c.name", r"\.")[i]
    return named.select("log_id", part(0).alias("msg_type"), part(1).alias("field"), "seq", "t", F.when(F.col("c.good"), F.col("v") - 5).otherwise(1000.0).alias("v"))


@query("win7_wind_source", f"with {SAMPLES}, {_WINDS} select log_id, seq, t, round(speed, 6) + 0.0 as speed, source from winds")
def wind_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(spans.wind_speeds(wind_fields(event_samples(spark, sf_dir))), "speed")


_FLYING = """m as (select *, exists (select 1 from spans p where p.log_id = w.log_id and w.t between p.start_t and p.end_t) as inside from winds w),
f as (select *, max(inside) over (partition by log_id) as filtered from m),
wind_stats as (select log_id, any_value(source) as wind_source, avg(speed) as wind_mean, max(speed) as wind_max from f where (inside or not filtered) and speed >= 0 group by log_id)"""


@query("agg2_wind_stats", f"with {_ALL}, {_WINDS}, {_FLYING} select log_id, wind_source, round(wind_mean, 6) as wind_mean, round(wind_max, 6) as wind_max from wind_stats")
def wind_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _stored_samples(spark, sf_dir)
    return rounded_all(spans.wind_stats(spans.wind_speeds(wind_fields(samples)), all_spans(samples)), "wind_mean", "wind_max")


_TOTALS = "totals as (select log_id, count(*) as flights, max(duration) as longest, arg_min(start_t, struct_pack(d := -duration, s := start_t)) as longest_start, sum(duration) as armed_total from spans group by log_id)"


@query("agg3_flight_totals", f"with {_ALL}, {_TOTALS} select log_id, flights, round(longest, 6) + 0.0 as longest, longest_start, round(armed_total, 6) + 0.0 as armed_total from totals")
def flight_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(spans.flight_totals(all_spans(_stored_samples(spark, sf_dir))), "longest", "armed_total")


_SUMMARY = f"""with {_ALL}, {_WINDS}, {_FLYING}, {_TOTALS}, logs as (select log_id, max(t) - min(t) as duration from samples group by log_id), sources as (select log_id, any_value(source) as s from spans group by log_id),
summary as (select log_id, duration, coalesce(s, 'none') as arming_source, coalesce(flights, 0) as flights, longest, coalesce(armed_total, 0) as armed_total, coalesce(wind_source, 'None') as wind_source, wind_mean, wind_max
    from logs left join totals using (log_id) left join sources using (log_id) left join wind_stats using (log_id))"""


@query("sum1_log_summary", f"{_SUMMARY} select log_id, round(duration, 6) + 0.0 as duration, arming_source, flights, round(longest, 6) + 0.0 as longest, round(armed_total, 6) + 0.0 as armed_total, wind_source, round(wind_mean, 6) as wind_mean, round(wind_max, 6) as wind_max from summary")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _stored_samples(spark, sf_dir)
    return rounded_all(spans.log_summary(samples, all_spans(samples), spans.wind_speeds(wind_fields(samples))), "duration", "longest", "armed_total", "wind_mean", "wind_max")


def _duration_sql(x: str) -> str:
    n = f"cast(round_even({x}, 0) as bigint)"
    return f"case when {n} >= 3600 then printf('%dh %dm %ds', {n} // 3600, {n} % 3600 // 60, {n} % 60) when {n} >= 60 then printf('%dm %ds', {n} // 60, {n} % 60) else printf('%ds', {n}) end || printf(' (%.1f s)', {x})"


#: Whole tenths, so that no text depends on how a tie is rounded.
_SECONDS = "floor((v * v * (k % 9)) * 10) / 10"


@query("str2_duration_text", f"with {SAMPLES}, x as (select seq, {_SECONDS} as d from samples) select seq, {_duration_sql('d')} as text from x")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.col("v") * F.col("v") * (F.col("k") % 9) * 10) / 10
    return event_samples(spark, sf_dir).select("seq", texts.duration_text(seconds.cast("double")).alias("text"))


@query(
    "str3_flight_time_text",
    f"""with {SAMPLES}, x as (select seq, {_SECONDS} as d, k % 4 as n, floor(v) as total from samples)
    select seq, case when d > 0 then {_duration_sql('d')} || case when n > 1 then printf(' (Longest of %d flights)', n) else '' end when total > 0 then printf('%dm %ds (%.1f s) [Full Log]', cast(total as bigint) // 60, cast(total as bigint) % 60, total) else 'N/A' end as text from x""",
)
def flight_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.floor(F.col("v") * F.col("v") * (F.col("k") % 9) * 10) / 10).cast("double")
    return event_samples(spark, sf_dir).select("seq", texts.flight_time_text(seconds, F.col("k") % 4, F.floor("v").cast("double")).alias("text"))


@query(
    "str4_wind_text",
    f"""with {SAMPLES}, x as (select seq, case when k % 5 > 0 then floor(v * 2) / 2 end as m, case when k % 5 > 0 then floor(v * 2) / 2 + 5 end as w from samples)
    select seq, case when m is not null then printf('Avg: %.1f m/s (%.1f km/h) | Max: %.1f m/s (%.1f km/h)', m, m * 3.6, w, w * 3.6) else 'N/A (No wind data)' end as text from x""",
)
def wind_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.when(F.col("k") % 5 > 0, (F.floor(F.col("v") * 2) / 2).cast("double"))
    return event_samples(spark, sf_dir).select("seq", texts.wind_text(mean, mean + 5).alias("text"))


@query(
    "str1_mode_name",
    f"""with {SAMPLES}, x as (select seq, log_id % 2 = 0 as copter, case when k % 4 = 3 then ' auto/' || series else cast(k % 30 as varchar) end as mode from samples), y as (select *, try_cast(mode as int) as n from x)
    select seq, case when n is null then upper(trim(split_part(trim(mode), '/', 1))) when copter then {_cases(texts.COPTER_MODES)} else {_cases(texts.PLANE_MODES)} end as name from y""",
)
def mode_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("k") % 4 == 3, F.concat(F.lit(" auto/"), "series")).otherwise((F.col("k") % 30).cast("string"))
    return event_samples(spark, sf_dir).select("seq", texts.mode_name(mode, F.col("log_id") % 2 == 0).alias("name"))


@query(
    "str5_value_text",
    f"""with {SAMPLES} select seq, case k % 4 when 0 then cast(cast(floor(v) as bigint) as varchar) when 1 then 'b''X ' || k || '''' else cast(floor(v * 100) / 100 as varchar) end as raw,
    case k % 4 when 0 then cast(cast(floor(v) as bigint) as varchar) when 1 then 'X ' || k else regexp_replace(regexp_replace(printf('%.2f', floor(v * 100) / 100), '0+$', ''), '\\.$', '') end as text from samples""",
)
def value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, two = F.col("k") % 4, (F.floor(F.col("v") * 100) / 100).cast("double")
    raw = F.when(kind == 0, F.floor("v").cast("string")).when(kind == 1, F.concat(F.lit("b'X "), F.col("k").cast("string"), F.lit("'"))).otherwise(two.cast("string"))
    return event_samples(spark, sf_dir).select("seq", raw.alias("raw"), texts.value_text(raw).alias("text"))


@query("cat17_text_cleaning", f"with {SAMPLES} select seq, 'name ' || k as text from samples")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped, padded and plain forms of one text give the same."""
    name = F.concat(F.lit("name "), F.col("k").cast("string"))
    form = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("b'"), name, F.lit("\\x00'"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("  "), name, F.lit("\x00\x00 "))).otherwise(name)
    return event_samples(spark, sf_dir).select("seq", texts.clean_text(form).alias("text"))


_PARAMS = "raw as (select log_id % 4 as log_id, series || (k % 20) as name, seq, case when k % 5 = 0 then 'T' || (seq % 2) else cast(cast(floor(v / 20) as bigint) as varchar) end as value from samples), params as (select log_id, name, arg_max(value, seq) as value from raw group by all)"


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("k") % 5 == 0, F.concat(F.lit("T"), (F.col("seq") % 2).cast("string"))).otherwise(F.floor(F.col("v") / 20).cast("string"))
    return event_samples(spark, sf_dir).select((F.col("log_id") % 4).alias("log_id"), F.concat("series", (F.col("k") % 20).cast("string")).alias("name"), "seq", value.alias("value"))


@query("agg4_last_params", f"with {SAMPLES}, {_PARAMS} select * from params")
def last_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.last_values(_params(spark, sf_dir))


_DIFF = f"""{SAMPLES}, {_PARAMS}, wide as (select name, {", ".join(f"max(value) filter (log_id = {k}) as F{k + 1}" for k in range(4))} from params group by name),
diff as (select *, {" or ".join(f"(case when F1 is null and F{k} is null then false when F1 is null or F{k} is null then true when try_cast(F1 as double) is not null and try_cast(F{k} as double) is not null then abs(try_cast(F1 as double) - try_cast(F{k} as double)) > 1e-6 else F1 <> F{k} end)" for k in (2, 3, 4))} as differs from wide)"""


def labelled_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.last_values(_params(spark, sf_dir)).withColumn("label", F.concat(F.lit("F"), (F.col("log_id") + 1).cast("string")))


LABELS = ["F1", "F2", "F3", "F4"]


@query("join10_param_diff", f"with {_DIFF} select name, F1, F2, F3, F4, differs from diff where differs")
def param_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.param_diff(labelled_params(spark, sf_dir), LABELS)


@query("agg5_diff_counts", f"with {_DIFF} select count(*) as compared, count(*) filter (differs) as differing from diff")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.diff_counts(params.param_diff(labelled_params(spark, sf_dir), LABELS, only_diff=False))


@query("set2_param_names", f"with {SAMPLES}, {_PARAMS} select distinct name from params")
def param_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return params.param_names(_params(spark, sf_dir))


@query("cat21_searches", f"with {SAMPLES}, {_PARAMS}, {_DIFF.split(_PARAMS + ', ')[1]} select 'param' as kind, name from params where contains(upper(name), 'ICK1') union all select 'diff', name from diff where differs and contains(upper(name), 'ICK1') union all select 'message', 'Text ' || series || k from samples where contains(lower('Text ' || series || k), 'view1')")
def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = params.search(params.last_values(_params(spark, sf_dir)), "name", "ick1").select(F.lit("param").alias("kind"), "name")
    changed = params.search(params.param_diff(labelled_params(spark, sf_dir), LABELS), "name", "ick1").select(F.lit("diff"), "name")
    told = event_samples(spark, sf_dir).select(F.concat(F.lit("Text "), "series", F.col("k").cast("string")).alias("text"))
    return found.union(changed).union(params.search(told, "text", "View1").select(F.lit("message"), "text"))


@query("top3_sorted_params", f"with {SAMPLES}, {_PARAMS} select log_id, name, value, row_number() over (partition by log_id order by name) as place from params")
def sorted_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of each log in order of names."""
    return params.last_values(_params(spark, sf_dir)).withColumn("place", F.row_number().over(Window.partitionBy("log_id").orderBy("name")))


