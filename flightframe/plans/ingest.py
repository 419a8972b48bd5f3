"""Queries: CSV logs.  The lines of the logs are made from events, and the results are held against the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.plans.base import FIELDS, SAMPLES, query, rounded_all
from flightframe.sources import csv_logs, sample_store
from flightframe.sources.events import event_fields, event_samples
from flightframe.sources.store import shared_folder

#: By log_id % 6: header line, and how a row is written.
HEADERS = ["time;ax;ay", "TimeUS,IMU.Roll,IMU.Pitch", "var_a,var_b", "time(millisecond)\tgyro_x\tgyro_y", "Parameter,Value", "timestamp,val"]
#: Positions of the made files are named so that their group comes from the columns, or from the name.
_FILE = "concat('dir/', case log_id % 6 when 1 then 'rec' when 2 then 'my-log_20260917_143651' when 3 then 'flightgps' else 'x' end, log_id, '.csv')"


def made_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id: a file name, line_no, line): comments, header and one row per event."""
    samples = event_samples(spark, sf_dir)
    kind = F.col("log_id") % 6
    file = F.concat(F.lit("dir/"), F.when(kind == 1, "rec").when(kind == 2, "my-log_20260917_143651").when(kind == 3, "flightgps").otherwise("x"), F.col("log_id").cast("string"), F.lit(".csv"))
    v, k, seq = F.col("v").cast("string"), F.when(F.col("k") % 7 == 0, "").otherwise(F.col("k").cast("string")), F.col("seq")
    clock = F.date_format(F.timestamp_seconds(seq * 60), "yyyy-MM-dd HH:mm:ss")
    row = (
        F.when(kind == 0, F.concat_ws(";", seq.cast("string"), v, k))
        .when(kind == 1, F.concat_ws(",", (seq * 20000 + 200000000).cast("string"), v, k))
        .when(kind == 2, F.concat_ws(",", v, F.concat(k, F.lit(" # note"))))
        .when(kind == 3, F.concat_ws("\t", (seq * 50 + 100000).cast("string"), v, k))
        .when(kind == 4, F.concat_ws(",", F.concat(F.lit(" P"), (F.col("k") % 10).cast("string"), F.lit(" ")), v))
        .otherwise(F.concat_ws(",", F.when(F.col("k") % 7 == 0, "").otherwise(clock), v))
    )
    rows = samples.select(file.alias("log_id"), (seq + 10).alias("line_no"), row.alias("line"))
    files = samples.select(file.alias("log_id"), F.col("log_id").alias("n")).distinct()
    head = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("n") % 6 + 1).cast("int"))
    lines = F.array(F.concat(F.lit("# Start Time: log "), F.col("n").cast("string")), F.lit(""), F.concat(F.lit("// Sensor  Set : c"), (F.col("n") % 3).cast("string")), F.lit("# no colon"), head)
    return files.select("log_id", F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long")).unionByName(rows)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_logs.parsed(csv_logs.prepared(made_lines(spark, sf_dir)))


_LOGS = f"files as (select distinct log_id as n, {_FILE} as file from samples), x as (select * exclude (t), {_FILE} as file, log_id % 6 as kind, seq + 10 as line_no, case when k % 7 = 0 then 0 else k end as kk from samples)"
_LONG = """clocked as (select *, case kind when 0 then case when max(seq) over (partition by file) > 1e5 then seq / 1000.0 else seq end when 1 then (seq * 20000 + 200000000) / 1e6 when 2 then (row_number() over (partition by file order by seq) - 1) * 0.1
    when 3 then (seq * 50 + 100000) / 1000.0 when 5 then case when k % 7 = 0 then 0 else seq * 60 - arg_min(seq * 60, seq) filter (k % 7 <> 0) over (partition by file) end end as t0 from x),
scaled as (select *, case when kind = 5 and max(t0) over (partition by file) > 1e8 then t0 / 1e6 when kind = 5 and max(t0) over (partition by file) > 1e5 then t0 / 1000 else t0 end as t from clocked),
long as (select file as log_id, 'IMU' as msg_type, unnest(['Roll', 'Pitch']) as field, line_no, t, unnest([v, kk]) as v from scaled where kind = 1
    union all select file, 'X' || n, unnest(['ax', 'ay']), line_no, t, unnest([v, kk]) from scaled join files using (file) where kind = 0
    union all select file, 'MY_LOG', unnest(['var_a', 'var_b']), line_no, t, unnest([v, kk]) from scaled where kind = 2
    union all select file, 'GPS', unnest(['gyro_x', 'gyro_y']), line_no, t, unnest([v, kk]) from scaled where kind = 3
    union all select file, 'X' || n, 'val', line_no, t, v from scaled join files using (file) where kind = 5)"""


@query("src1_csv_samples", f"with {SAMPLES}, {_LOGS}, {_LONG} select log_id, msg_type, field, msg_type || '.' || field as series, line_no, round(t, 6) + 0.0 as t, v from long")
def csv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(csv_logs.csv_samples(_rows(spark, sf_dir)), "t")


@query("src2_delimiters", f"with {SAMPLES}, {_LOGS} select file as log_id, case n % 6 when 0 then ';' when 3 then chr(9) else ',' end as sep from files")
def delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_logs.layouts(made_lines(spark, sf_dir)).select("log_id", "sep")


@query(
    "src3_header_comments",
    f"""with {SAMPLES}, {_LOGS} select 'param' as kind, file as log_id, 'Start_Time' as name, 'log ' || n as value from files union all select 'param', file, 'Sensor_Set', 'c' || (n % 3) from files
    union all select 'message', file, null, unnest(['Start Time: log ' || n, 'Sensor  Set : c' || (n % 3), 'no colon']) from files""",
)
def header_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    params, messages = csv_logs.header_comments(made_lines(spark, sf_dir))
    return params.select(F.lit("param").alias("kind"), "log_id", "name", "value").unionByName(messages.select(F.lit("message").alias("kind"), "log_id", F.lit(None).cast("string").alias("name"), F.col("text").alias("value")))


@query("src4_param_files", f"with {SAMPLES}, {_LOGS} select file as log_id, line_no, 'P' || (k % 10) as name, cast(v as varchar) as value from x where kind = 4")
def param_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_logs.param_rows(_rows(spark, sf_dir))


@query("src5_time_columns", f"with {SAMPLES}, {_LOGS} select file as log_id, case n % 6 when 0 then 'time' when 1 then 'TimeUS' when 3 then 'time(millisecond)' when 5 then 'timestamp' end as time_column from files")
def time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = csv_logs.layouts(made_lines(spark, sf_dir))
    return found.select("log_id", F.when(F.col("time_pos") > 0, F.try_element_at("names", F.col("time_pos"))).alias("time_column"))


@query("src6_times", f"with {SAMPLES}, {_LOGS}, {_LONG} select file as log_id, line_no, round(t, 6) + 0.0 as t from scaled where kind <> 4")
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_all(csv_logs.with_time(_rows(spark, sf_dir).where("not is_params")), "t").select("log_id", "line_no", "t")


@query("src7_group_names", f"with {SAMPLES}, {_LOGS} select file as log_id, case n % 6 when 1 then 'ATT' when 2 then 'MY_LOG' when 3 then 'GPS' else 'X' || n end as msg_group from files")
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_logs.layouts(made_lines(spark, sf_dir)).select("log_id", "msg_group")


@query("src8_dotted_columns", f"with {SAMPLES}, {_LOGS}, {_LONG} select distinct log_id, msg_type, field from long where field in ('Roll', 'Pitch')")
def dotted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_logs.csv_samples(_rows(spark, sf_dir)).where("field in ('Roll', 'Pitch')").select("log_id", "msg_type", "field").distinct()


@query("src9_numbers", f"with {SAMPLES} select seq, case k % 4 when 0 then 0 when 1 then v when 2 then 0 else k end as v from samples")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("k") % 4
    text = F.when(kind == 0, "").when(kind == 1, F.col("v").cast("string")).when(kind == 2, F.when(F.col("k") % 8 == 2, "NaN").otherwise("abc")).otherwise(F.col("k").cast("string"))
    return event_samples(spark, sf_dir).select("seq", csv_logs.number_or_zero(text).alias("v"))


@query(
    "src10_vendor_samples",
    f"""with {SAMPLES}, x as (select * exclude (t), case log_id % 3 when 0 then seq * 50.0 when 1 then seq end as raw, row_number() over (partition by log_id order by seq) - 1 as r from samples),
    y as (select *, case log_id % 3 when 2 then r * 0.1 when 0 then case when max(raw) over (partition by log_id) > 10000 then raw / 1000 else raw end else raw end as t from x)
    select log_id, 'DJI' as msg_type, unnest(['height', 'speed']) as field, seq + 10 as line_no, round(t, 6) + 0.0 as t, unnest([v, case when k % 7 = 0 then 0 else k end]) as v from y""",
)
def vendor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, kind = event_samples(spark, sf_dir), F.col("log_id") % 3
    k = F.when(F.col("k") % 7 == 0, "bad").otherwise(F.col("k").cast("string"))
    row = F.when(kind == 0, F.concat_ws(",", (F.col("seq") * 50).cast("string"), F.col("v").cast("string"), k)).when(kind == 1, F.concat_ws(",", F.col("v").cast("string"), k, F.col("seq").cast("string"))).otherwise(F.concat_ws(",", F.col("v").cast("string"), k))
    head = F.when(kind == 0, "time(millisecond),height,speed").when(kind == 1, "height,speed,Tick").otherwise("height,speed")
    files = samples.select("log_id").distinct().select("log_id", F.lit(0).cast("long").alias("line_no"), head.alias("line"))
    lines = files.unionByName(samples.select("log_id", (F.col("seq") + 10).alias("line_no"), row.alias("line")))
    return rounded_all(csv_logs.vendor_samples(lines), "t")


@query(
    "src11_load_list",
    f"""with {SAMPLES}, p as (select 'log' || (seq % 400) || '.csv' as path, min(seq) as pos from samples where k % 5 <> 0 group by all) select path, 'F' || row_number() over (order by pos) as label from p""",
)
def load_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = event_samples(spark, sf_dir).select(F.concat(F.lit("log"), (F.col("seq") % 400).cast("string"), F.lit(".csv")).alias("path"), F.col("seq").alias("pos"), (F.col("k") % 5 != 0).alias("there"))
    return csv_logs.load_list(files)


def _store(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    sample_store.write_store(event_fields(spark, sf_dir), path)
    return path


@query("src12_sample_store", f"with {SAMPLES}, {FIELDS} select log_id, msg_type, field, seq, t, v from rows where msg_type in ('view', 'error') and t between 1704500000 and 1706000000")
def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_store.read_store(spark, _store(spark, sf_dir), ["view", "error"], low=1704500000.0, high=1706000000.0).select("log_id", "msg_type", "field", "seq", "t", "v")


@query("cat1_stored_catalog", f"with {SAMPLES}, {FIELDS} select msg_type, log_id, field, count(*) as n, min(t) as t_first, max(t) as t_last from rows group by all")
def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_store.catalog(spark, _store(spark, sf_dir))
