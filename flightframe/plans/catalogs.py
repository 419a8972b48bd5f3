"""Queries: catalogs, instances, units and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.operators import catalog, logs
from flightframe.plans.base import FIELDS, SAMPLES, query, rounded_all
from flightframe.sources.events import event_fields, event_samples
from flightframe.sources.messages import message_samples, text_messages


@query("cat1_field_catalog", f"with {SAMPLES}, {FIELDS} select log_id, msg_type, list_sort(list(distinct field)) as fields from rows group by all")
def field_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fields_of(event_fields(spark, sf_dir))


#: Decoded messages whose time is in one of several fields, or missing.
_MESSAGES = """msgs as (select log_id, case when k % 11 = 0 then 'PARM' else upper(series) end as msg_type, seq, k,
    case log_id % 4 when 0 then seq * 1000.0 / 1e6 when 1 then seq * 10.0 / 1e3 when 2 then seq * 1.0 end as own_t, v from samples),
timed as (select *, coalesce(own_t, row_number() over (partition by log_id, msg_type order by seq) - 1) as t from msgs where msg_type <> 'PARM')"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, kind = event_samples(spark, sf_dir), F.col("log_id") % 4
    clock = F.when(kind == 0, F.create_map(F.lit("TimeUS"), F.col("seq") * F.lit(1000.0))).when(kind == 1, F.create_map(F.lit("TimeMS"), F.col("seq") * F.lit(10.0))).when(kind == 2, F.create_map(F.lit("Time"), F.col("seq") * F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    fields = F.map_concat(F.create_map(F.lit("Val"), F.col("v"), F.lit("I"), (F.col("k") % 3).cast("double")), clock)
    return samples.select("log_id", F.when(F.col("k") % 11 == 0, "PARM").otherwise(F.upper("series")).alias("msg_type"), "seq", fields.alias("fields"), "k")


@query("src12_message_samples", f"with {SAMPLES}, {_MESSAGES} select log_id, msg_type, seq, round(t, 6) + 0.0 as t, 'Val' as field, v, msg_type || '.Val' as series from timed union all select log_id, msg_type, seq, round(t, 6) + 0.0, 'I', cast(k % 3 as double), msg_type || '.I' from timed")
def decoded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(message_samples(_messages(spark, sf_dir)).where("field in ('Val', 'I')"), "t")


@query("cat2_message_time", f"with {SAMPLES}, {_MESSAGES} select log_id, msg_type, seq, round(t, 6) + 0.0 as t from timed")
def message_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(message_samples(_messages(spark, sf_dir)).where("field = 'Val'"), "t").select("log_id", "msg_type", "seq", "t")


@query(
    "cat3_multipliers",
    f"""with {SAMPLES}, {FIELDS}, formats as (select distinct msg_type, field, case field when 'Lat' then 0.01 when 'Lng' then 100.0 when 'Alt' then 1.0 end as mult from rows where field in ('Lat', 'Lng', 'Alt'))
    select r.log_id, r.series, seq, round(case when mult > 0 and mult < 1 then v / (1 / mult) when mult <> 1 then v * mult else v end, 6) + 0.0 as v from rows r left join formats f on r.msg_type = f.msg_type and r.field = f.field""",
)
def multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_fields(spark, sf_dir)
    name = F.col("field")
    formats = rows.select("msg_type", "field").where(name.isin("Lat", "Lng", "Alt")).distinct().withColumn("mult", F.when(name == "Lat", 0.01).when(name == "Lng", 100.0).otherwise(1.0))
    return rounded_all(catalog.scaled(rows, formats), "v").select("log_id", "series", "seq", "v")


#: Message rows with candidate instance columns: IMU (I), GPS (one value), PIDR (never), VIEW (Id, 4 values), ERR (halves).
_INSTANCES = """im as (select log_id, case series when 'click' then 'IMU' when 'error' then 'GPS' when 'purchase' then 'PIDR' when 'signup' then 'ERR' else 'VIEW' end as msg_type, seq, t,
    case series when 'click' then 'I' when 'error' then 'I' when 'purchase' then 'I' when 'signup' then 'C' else 'Id' end as field,
    case series when 'click' then k % 3 when 'error' then 1 when 'purchase' then k % 2 when 'signup' then k / 2 else k % 4 end as x from samples),
facts as (select log_id, msg_type, any_value(field) as field, count(distinct x) as n_instances, min(x) as lo, max(x) as hi, bool_and(abs(x - round_even(x, 0)) < 1e-4) as whole from im group by all),
columns_ as (select log_id, msg_type, field, n_instances from facts where msg_type not in ('PIDR') and n_instances between 1 and 32 and whole and lo >= 0 and hi <= 255 and (n_instances > 1 or msg_type in ('IMU', 'GPS')))"""


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("series"), F.col("k")
    message = F.when(s == "click", "IMU").when(s == "error", "GPS").when(s == "purchase", "PIDR").when(s == "signup", "ERR").otherwise("VIEW")
    field = F.when(s == "signup", "C").when(s == "view", "Id").otherwise("I")
    x = F.when(s == "click", k % 3).when(s == "error", 1).when(s == "purchase", k % 2).when(s == "signup", k / 2).otherwise(k % 4).cast("double")
    return event_samples(spark, sf_dir).select("log_id", message.alias("msg_type"), "seq", "t", F.create_map(field, x, F.lit("Val"), F.col("v")).alias("fields"))


@query("cat4_instance_columns", f"with {SAMPLES}, {_INSTANCES} select * from columns_")
def instance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.instance_columns(_instances(spark, sf_dir).select("log_id", "msg_type", F.explode("fields").alias("field", "v")))


_SPLIT = f"{_INSTANCES}, split as (select i.log_id, i.seq, i.msg_type as flat, case when c.field is not null then i.msg_type || '[' || cast(x as bigint) || ']' else i.msg_type end as msg_type from im i left join columns_ c on i.log_id = c.log_id and i.msg_type = c.msg_type)"


@query("cat5_instance_split", f"with {SAMPLES}, {_SPLIT} select * from split")
def instance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.split_instances(_instances(spark, sf_dir)).select("log_id", "seq", "flat", "msg_type")


@query(
    "cat6_primary_instance",
    f"with {SAMPLES}, {_SPLIT}, c as (select log_id, flat, msg_type, count(*) as n, min(seq) as f from split where flat <> msg_type group by all) select log_id, flat, arg_max(msg_type, struct_pack(n := n, f := -f)) as msg_type, max(n) as n from c group by all",
)
def primary_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.primary_instances(catalog.split_instances(_instances(spark, sf_dir)))


@query(
    "cat7_system_split",
    f"""with {SAMPLES}, x as (select log_id, case when log_id % 2 = 0 then k % 3 else k % 2 end as sysid, upper(series) as m, seq from samples), n as (select log_id, count(distinct sysid) filter (sysid <> 0) as c from x group by log_id)
    select log_id, seq, case when c > 1 then m || '[S' || sysid || ']' else m end as msg_type from x join n using (log_id)""",
)
def system_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_samples(spark, sf_dir).select("log_id", F.when(F.col("log_id") % 2 == 0, F.col("k") % 3).otherwise(F.col("k") % 2).alias("sysid"), F.upper("series").alias("msg_type"), "seq")
    return catalog.split_systems(rows).select("log_id", "seq", "msg_type")


@query("agg6_instance_counts", f"with {SAMPLES} select log_id, count(distinct k % 4) filter (k % 4 <> 0) as systems, count(distinct k % 6) as instances from samples group by log_id")
def instance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.instance_counts(event_samples(spark, sf_dir).select("log_id", (F.col("k") % 4).alias("sysid"), (F.col("k") % 6).alias("instance")))


@query("cat8_select_instance", f"with {SAMPLES} select seq, k % 3 as \"I\", v from samples where k % 3 = 1")
def select_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.select_instance(event_samples(spark, sf_dir).select("seq", (F.col("k") % 3).alias("I"), "v"), 1)


@query(
    "cat10_message_fields",
    f"""with {SAMPLES}, {FIELDS} select distinct log_id, msg_type, field from rows where msg_type = 'view' or (msg_type = 'click' and field = 'Roll')""",
)
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_fields(spark, sf_dir)
    asked = rows.where("msg_type = 'view'").select("log_id", "msg_type").distinct()
    return catalog.fields_for_messages(rows, asked, rows.where("msg_type = 'click' and field = 'Roll'"))


@query(
    "cat11_distinct_requests",
    f"""with {SAMPLES}, items as (select log_id, seq * 2 as first, series from samples where k % 3 = 0 union all select log_id, seq * 2, series from samples where k % 3 = 1 union all select log_id, seq * 2 + 1, 'view' from samples where k % 3 = 1)
    select log_id, series, min(first) as first from items group by all""",
)
def distinct_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_samples(spark, sf_dir)
    single = rows.where("k % 3 = 0").select("log_id", F.col("seq").alias("pos"), "series")
    pairs = rows.where("k % 3 = 1").select("log_id", F.col("seq").alias("pos"), F.col("series").alias("x_series"), F.lit("view").alias("y_series"))
    return logs.distinct_requests(single, pairs)


@query("cat12_field_search", f"with {SAMPLES}, {FIELDS} select distinct log_id, msg_type, field from rows where contains(upper(msg_type), 'L') or contains(upper(field), 'L')")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.field_search(event_fields(spark, sf_dir), "l")


@query(
    "cat14_position_messages",
    f"""with {SAMPLES}, {FIELDS}, c as (select log_id, msg_type, count(*) filter (field = 'Lat') as lat, count(*) filter (field = 'Lng') as lng, count(*) filter (field = 'Alt') as alt from rows group by all)
    select log_id, msg_type, 'Lat' as lat_field, 'Lng' as lon_field, 'Alt' as alt_field, lat as samples from c where lat > 0 and lng > 0 and alt > 0""",
)
def position_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.position_messages(event_fields(spark, sf_dir))


@query("cat15_sensor_vectors", f"with {SAMPLES}, {FIELDS} select log_id, msg_type, msg_type || ' - Acc' as name, ['AccX', 'AccY', 'AccZ'] as axes from rows where field in ('AccX', 'AccY', 'AccZ') group by all having count(distinct field) = 3")
def sensor_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sensor_vectors(event_fields(spark, sf_dir))


#: Series in the units of the wire: radians, 1e-7 degrees, millimetres, centimetres a second.
_UNITS = """named as (select log_id, case series when 'click' then 'ATTITUDE' when 'error' then 'GPS_RAW_INT' when 'purchase' then 'GLOBAL_POSITION_INT[1]' else upper(series) end as msg_type,
    case series when 'click' then 'Roll' when 'error' then 'lat' when 'purchase' then 'alt' when 'signup' then 'lon' else 'vx' end as field, seq, t,
    case series when 'click' then v / case when log_id % 2 = 0 then 100 else 1 end when 'error' then v * 1e5 when 'purchase' then v * case when log_id % 2 = 0 then 1000 else 1 end else v end as v from samples),
facts as (select log_id, msg_type, field, max(abs(v)) as most, avg(abs(v)) as mean from named group by all)"""


@query(
    "cat16_unit_conversions",
    f"""with {SAMPLES}, {_UNITS} select log_id, msg_type, field, seq, round(case when msg_type = 'ATTITUDE' and most <= 7 then degrees(v) when field in ('lat', 'lon') and most > 180 then v / 1e7
        when field = 'alt' and (most > 5000 or mean > 1000) then v / 1000 else v end, 6) + 0.0 as v from named join facts using (log_id, msg_type, field)""",
)
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, even = F.col("series"), F.col("log_id") % 2 == 0
    message = F.when(s == "click", "ATTITUDE").when(s == "error", "GPS_RAW_INT").when(s == "purchase", "GLOBAL_POSITION_INT[1]").otherwise(F.upper(s))
    field = F.when(s == "click", "Roll").when(s == "error", "lat").when(s == "purchase", "alt").when(s == "signup", "lon").otherwise("vx")
    v = F.when(s == "click", F.col("v") / F.when(even, 100).otherwise(1)).when(s == "error", F.col("v") * 1e5).when(s == "purchase", F.col("v") * F.when(even, 1000).otherwise(1)).otherwise(F.col("v"))
    rows = event_samples(spark, sf_dir).select("log_id", message.alias("msg_type"), field.alias("field"), "seq", "t", v.alias("v"))
    return rounded_all(catalog.unit_conversions(rows), "v").select("log_id", "msg_type", "field", "seq", "v")


@query(
    "cat18_field_presence",
    f"""with {SAMPLES}, {FIELDS}, h as (select distinct log_id, series from rows) select log_id, series, null::varchar as other from h where series in ('click.Lat', 'view.Roll')
    union all select a.log_id, a.series, b.series from h a join h b on a.log_id = b.log_id and a.series = 'click.Lat' and b.series = 'view.Lat'""",
)
def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_fields(spark, sf_dir)
    names = rows.select("series").distinct()
    single = names.where(F.col("series").isin("click.Lat", "view.Roll"))
    pairs = names.where("series = 'click.Lat'").select(F.col("series").alias("x_series"), F.lit("view.Lat").alias("y_series"))
    one, two = catalog.present_pairs(rows, single, pairs)
    return one.select("log_id", "series", F.lit(None).cast("string").alias("other")).unionByName(two.select("log_id", F.col("x_series").alias("series"), F.col("y_series").alias("other")))


@query(
    "cat20_text_messages",
    f"""with {SAMPLES}, x as (select log_id, case series when 'click' then 'MSG' when 'view' then 'STATUSTEXT' when 'error' then 'EV' else series end as m, t, 'text ' || k as text, k from samples)
    select 'text' as kind, log_id, t, text as name, null::varchar as event_type from x where m in ('MSG', 'STATUSTEXT') union all select 'event', log_id, t, 'MSG: ' || text, 'INFO' from x where m in ('MSG', 'STATUSTEXT') union all select 'event', log_id, t, 'EV: ' || k, 'EV' from x where m = 'EV'""",
)
def messages_and_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("series")
    rows = event_samples(spark, sf_dir).select("log_id", F.when(s == "click", "MSG").when(s == "view", "STATUSTEXT").when(s == "error", "EV").otherwise(s).alias("msg_type"), "seq", "t", F.concat(F.lit("text "), F.col("k").cast("string")).alias("text"), F.col("k").alias("id"))
    told, events = text_messages(rows)
    return told.select(F.lit("text").alias("kind"), "log_id", "t", F.col("text").alias("name"), F.lit(None).cast("string").alias("event_type")).unionByName(events.select(F.lit("event").alias("kind"), "log_id", "t", "name", "event_type"))
