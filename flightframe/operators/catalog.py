"""Catalogs of fields, instance splits, and detection of positions and sensor vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages that come per instance, and messages that are never split.
# fmt: off
INSTANCED = [
    "XKF1", "XKF2", "XKF3", "XKF4", "XKQ1", "XKQ2", "XKQ", "NKF1", "NKF2", "NKF3", "NKF4", "NKQ1", "NKQ2", "NKQ", "IMU", "ACC", "GYR",
    "BARO", "MAG", "GPS", "POS", "GPA", "RFND", "BAT", "BAT2", "ESC", "ORGN", "AHR2", "RATE", "RAW_IMU", "SCALED_IMU", "SCALED_IMU2",
    "SCALED_IMU3", "BATTERY_STATUS", "DISTANCE_SENSOR", "MCU_STATUS",
]
NEVER_SPLIT = [
    "PARM", "FMT", "FMTU", "UNIT", "MSG", "EV", "MODE", "HEAT", "PIDR", "PIDP", "PIDY", "PIDA", "PIDZ", "PIDS", "TECS", "TECB", "PSCD",
    "PSCE", "PSCN", "STAT", "STATUSTEXT", "HEARTBEAT",
]
#: Instance columns in order of preference, reference messages of a log's segments, sources of its duration.
INSTANCE_COLUMNS = ["C", "I", "Instance", "instance", "Inst", "Core", "Id", "ID", "id", "sensor_id"]
SEGMENT_MESSAGES = [
    "ATT", "ATT[0]", "POS", "POS[0]", "GPS", "GPS[0]", "BARO", "BARO[0]", "IMU", "IMU[0]", "CTUN", "NTUN", "STAT", "ATTITUDE", "RAW_IMU",
    "HIGHRES_IMU", "GLOBAL_POSITION_INT", "VFR_HUD", "SERVO_OUTPUT_RAW", "GPS_RAW_INT", "SCALED_IMU", "SYS_STATUS",
]
DURATION_MESSAGES = ["ATT", "IMU", "XKF1", "POS", "GPS", "MODE"]
#: Fields of a sensor's axes and the name of the group, in order of preference.
VECTORS = [
    ("AccX", "AccY", "AccZ", "Acc"), ("GyrX", "GyrY", "GyrZ", "Gyr"), ("MagX", "MagY", "MagZ", "Mag"), ("xacc", "yacc", "zacc", "Acc"),
    ("xgyro", "ygyro", "zgyro", "Gyr"), ("xmag", "ymag", "zmag", "Mag"), ("VN", "VE", "VD", "Vel"), ("PN", "PE", "PD", "Pos"),
    ("vx", "vy", "vz", "Vel"), ("x", "y", "z", "Vector"), ("X", "Y", "Z", "Vector"),
]
#: Words that name a position's parts, and words that rule a field out.
POSITION_WORDS = {
    "lat": (["lat", "latitude"], ["status", "err", "acc"]),
    "lon": (["lon", "lng", "longitude"], ["status", "err", "acc"]),
    "alt": (["alt", "altitude", "h", "height"], ["status", "err", "target", "sp"]),
}
# fmt: on


def fields_of(rows: DataFrame) -> DataFrame:
    """rows(log_id, msg_type, field, ..) -> (log_id, msg_type, fields array): sorted and distinct."""
    return rows.groupBy("log_id", "msg_type").agg(F.sort_array(F.collect_set("field")).alias("fields"))


def scaled(rows: DataFrame, formats: DataFrame) -> DataFrame:
    """rows with v times the multiplier of formats(msg_type, field, mult); below 1 as a division by its inverse."""
    m = F.col("mult")
    value = F.when((m > 0) & (m < 1), F.col("v") / (1 / F.nullif(m, F.lit(0.0)))).when(m != 1, F.col("v") * m).otherwise(F.col("v"))
    return rows.join(formats, ["msg_type", "field"], "left").withColumn("v", value).drop("mult")


def base_message(message: Column) -> Column:
    return F.upper(F.split(message, r"\[")[0])


def instance_columns(rows: DataFrame) -> DataFrame:
    """(log_id, msg_type, field, n_instances) of the columns that split a message."""
    base = base_message(F.col("msg_type"))
    facts = rows.where(F.col("field").isin(INSTANCE_COLUMNS)).groupBy("log_id", "msg_type", "field").agg(
        F.count_distinct("v").alias("n_instances"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.bool_and((F.abs(F.col("v") - F.rint("v")) < 1e-4) & ~F.isnan("v")).alias("whole"),
    )
    split = ~base.isin(NEVER_SPLIT) & ~base.startswith("PID") & F.col("n_instances").between(1, 32) & F.col("whole") & (F.col("low") >= 0) & (F.col("high") <= 255)
    return facts.where(split & ((F.col("n_instances") > 1) | base.isin(INSTANCED))).select("log_id", "msg_type", "field", "n_instances")


def instance_name(message: Column, value: Column) -> Column:
    """MSG[k]; whole numbers without decimals."""
    text = F.when(value == F.rint(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.concat(message, F.lit("["), text, F.lit("]"))


def split_instances(rows: DataFrame) -> DataFrame:
    """rows(log_id, msg_type, seq, t, fields map<string,double>) with msg_type MSG[k] where a first instance column
    splits it, and flat: the name before."""
    long = rows.select("log_id", "msg_type", F.explode("fields").alias("field", "v"))
    place = F.array_position(F.array(*map(F.lit, INSTANCE_COLUMNS)), F.col("field"))
    chosen = instance_columns(long).groupBy("log_id", "msg_type").agg(F.min_by("field", place).alias("column"))
    named = rows.join(chosen, ["log_id", "msg_type"], "left").withColumn("k", F.try_element_at("fields", F.col("column")))
    return named.withColumn("flat", F.col("msg_type")).withColumn("msg_type", F.when(F.col("k").isNotNull(), instance_name(F.col("msg_type"), F.col("k"))).otherwise(F.col("msg_type"))).drop("k", "column")


def primary_instances(split: DataFrame) -> DataFrame:
    """(log_id, flat, msg_type, n): for each split message the instance with most rows (the first seen on ties)."""
    counts = split.where("msg_type <> flat").groupBy("log_id", "flat", "msg_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counts.groupBy("log_id", "flat").agg(F.max_by("msg_type", F.struct("n", -F.col("first"))).alias("msg_type"), F.max("n").alias("n"))


def split_systems(rows: DataFrame) -> DataFrame:
    """rows(log_id, sysid, msg_type, ..): MSG[S<id>] where a log has several systems other than 0."""
    several = rows.groupBy("log_id").agg(F.count_distinct(F.when(F.col("sysid") != 0, F.col("sysid"))).alias("systems"))
    return rows.join(several, "log_id").withColumn("msg_type", F.when(F.col("systems") > 1, F.concat("msg_type", F.lit("[S"), F.col("sysid").cast("string"), F.lit("]"))).otherwise(F.col("msg_type"))).drop("systems")


def select_instance(wide: DataFrame, k: int = 0) -> DataFrame:
    """Rows of one sensor: by the first present of the columns I, instance, Instance, IMU; unchanged without any."""
    for c in ("I", "instance", "Instance", "IMU"):
        if c in wide.columns:
            return wide.where(F.col(c) == k)
    return wide


def fields_for_messages(rows: DataFrame, messages: DataFrame, extras: DataFrame) -> DataFrame:
    """(log_id, msg_type, field): all fields of messages(log_id, msg_type), and extras(log_id, msg_type, field)."""
    every = rows.select("log_id", "msg_type", "field").distinct().join(messages, ["log_id", "msg_type"], "left_semi")
    return every.unionByName(extras.select("log_id", "msg_type", "field")).distinct()


def field_search(rows: DataFrame, text: str) -> DataFrame:
    """(log_id, msg_type, field): a match of the message keeps all its fields, whatever the case."""
    hit = F.upper("msg_type").contains(text.upper()) | F.upper("field").contains(text.upper())
    return rows.select("log_id", "msg_type", "field").distinct().where(hit)


def _best_field(role: str) -> Column:
    """Rank of a field for a role: equal before prefix before containing, each in the order of the words."""
    words, barred = POSITION_WORDS[role]
    name = F.lower("field")
    rank = F.lit(None).cast("int")
    tests = [lambda n, w: n == w, lambda n, w: n.startswith(w), lambda n, w: n.contains(w)]
    for k, (test, word) in reversed(list(enumerate((t, w) for t in tests for w in words))):
        rank = F.when(test(name, F.lit(word)), k).otherwise(rank)
    ruled_out = F.lit(False)
    for word in barred:
        ruled_out = ruled_out | name.contains(word)
    return F.when(~ruled_out, rank)


def position_messages(rows: DataFrame) -> DataFrame:
    """(log_id, msg_type, lat_field, lon_field, alt_field, samples) of messages with all three; CALC is left out."""
    counts = rows.where("msg_type <> 'CALC'").groupBy("log_id", "msg_type", "field").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = [F.min(F.when(_best_field(r).isNotNull(), F.struct(_best_field(r).alias("r"), "first", "field", "n"))).alias(r) for r in POSITION_WORDS]
    found = counts.groupBy("log_id", "msg_type").agg(*best).where("lat is not null and lon is not null and alt is not null")
    return found.select("log_id", "msg_type", *(F.col(f"{r}.field").alias(f"{r}_field") for r in POSITION_WORDS), F.col("lat.n").alias("samples"))


def sensor_vectors(rows: DataFrame) -> DataFrame:
    """(log_id, msg_type, name "MSG - Acc", axes array): of several triples of one name the first."""
    have = rows.groupBy("log_id", "msg_type").agg(F.collect_set("field").alias("have"))
    triples = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v[:3])).alias("axes"), F.lit(v[3]).alias("label")) for k, v in enumerate(VECTORS)))
    fit = F.filter(triples, lambda t: F.size(F.array_intersect(t["axes"], F.col("have"))) == 3)
    each = have.select("log_id", "msg_type", F.inline(fit))
    return each.groupBy("log_id", "msg_type", "label").agg(F.min_by("axes", "k").alias("axes")).select("log_id", "msg_type", F.concat("msg_type", F.lit(" - "), "label").alias("name"), "axes")


def unit_conversions(rows: DataFrame) -> DataFrame:
    """rows(log_id, msg_type, field, .., v) in degrees, metres and metres a second, decided for each whole series."""
    w = Window.partitionBy("log_id", "msg_type", "field")
    size = F.abs(F.nanvl("v", F.lit(None)))
    facts = rows.withColumn("most", F.max(size).over(w)).withColumn("mean", F.avg(F.abs("v")).over(w))
    base, name = base_message(F.col("msg_type")), F.lower("field")
    attitude = base.isin("ATTITUDE", "HIGHRES_IMU") & name.isin("roll", "pitch", "yaw") & (F.col("most") <= 7)
    angle = name.isin("lat", "lon", "latitude", "longitude", "lat_int", "lon_int") & (F.col("most") > 180)
    position = base.isin("GLOBAL_POSITION_INT", "GPS_RAW_INT", "GPS2_RAW", "GPS_INPUT", "POSITION_TARGET_GLOBAL_INT", "HOME_POSITION")
    height = position & name.isin("alt", "relative_alt") & ((F.col("most") > 5000) | (F.col("mean") > 1000))
    speed = position & name.isin("vx", "vy", "vz", "vel")
    v = F.col("v")
    return facts.withColumn("v", F.when(attitude, F.degrees(v)).when(angle, v / 1e7).when(height, v / 1000.0).when(speed, v / 100.0).otherwise(v)).drop("most", "mean")


def present_pairs(rows: DataFrame, series: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which logs have each series(series), and both of each pair(x_series, y_series)."""
    have = rows.select("log_id", "series").distinct()
    single = series.join(have, "series")
    x, y = have.withColumnRenamed("series", "x_series"), have.withColumnRenamed("series", "y_series")
    return single, pairs.join(x, "x_series").join(y, ["y_series", "log_id"])


def instance_counts(rows: DataFrame) -> DataFrame:
    """(log_id, systems, instances): distinct system ids other than 0, and distinct instance values."""
    return rows.groupBy("log_id").agg(F.count_distinct(F.when(F.col("sysid") != 0, F.col("sysid"))).alias("systems"), F.count_distinct("instance").alias("instances"))


def catalog_rates(rows: DataFrame) -> DataFrame:
    """rows(log_id, msg_type, instance, seq, t) -> (log_id, msg_type, rate): rows per instance over the log's duration.

    The duration is that of the first of a few messages with several rows and a later last row; one row gives no rate.
    """
    facts = rows.groupBy("log_id", "msg_type").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.count_distinct("instance")).alias("instances"), (F.max_by("t", "seq") - F.min_by("t", "seq")).alias("span"))
    place = F.array_position(F.array(*map(F.lit, DURATION_MESSAGES)), F.col("msg_type"))
    spans = facts.where((place > 0) & (F.col("n") > 1) & (F.col("span") > 0)).groupBy("log_id").agg(F.min_by("span", place).alias("duration"))
    return facts.where("n > 1").join(spans, "log_id").select("log_id", "msg_type", (F.col("n") / F.col("instances") / F.col("duration")).alias("rate"))


def rate_lookup(requests: DataFrame, catalog: DataFrame, measured: DataFrame) -> DataFrame:
    """requests(log_id, name) -> rate by exact name, the name before ".", before "[", else measured(log_id, name, rate)."""
    out = requests
    for k, c in enumerate((F.col("name"), F.split("name", r"\.")[0], F.split("name", r"\[")[0])):
        rates = catalog.select("log_id", F.col("msg_type").alias(f"n{k}"), F.col("rate").alias(f"r{k}"))
        out = out.withColumn(f"n{k}", c).join(rates, ["log_id", f"n{k}"], "left")
    out = out.join(measured.select("log_id", "name", F.col("rate").alias("r3")), ["log_id", "name"], "left")
    return out.select("log_id", "name", F.coalesce("r0", "r1", "r2", "r3", F.lit(0.0)).alias("rate"))


def reference_series(rows: DataFrame, asked: str = "") -> DataFrame:
    """rows(log_id, msg_type, ..) -> (log_id, msg_type): the asked message if it has rows, else the first of a list,
    else the one with most rows."""
    counts = rows.groupBy("log_id", "msg_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    place = F.array_position(F.array(*map(F.lit, SEGMENT_MESSAGES)), F.col("msg_type"))
    rank = F.when(F.col("msg_type") == asked, -1).when(place > 0, place).otherwise(len(SEGMENT_MESSAGES) + 1)
    longest = F.when(rank > len(SEGMENT_MESSAGES), -F.col("n")).otherwise(0)
    return counts.groupBy("log_id").agg(F.min_by("msg_type", F.struct(rank.alias("r"), longest.alias("n"), "first")).alias("msg_type"))
