"""Mode spans, armed spans and their sources, winds, and the log summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.functions.texts import mode_name
from flightframe.operators.align import inside_spans
from flightframe.operators.logs import total_duration
from flightframe.sources.store import stored

SHORTEST_S = 0.5
ARMED_BIT = 128
ARM, DISARM = 10, 11
#: Fields of STAT that say whether a vehicle is armed, in order.
STATE_FIELDS = ["Armed", "Arm", "ArmState"]

#: Where winds are looked for, in order: messages with their instance ("[*]": without one or with any), and for each their fields
#: in order (two are components).
WIND_SOURCES = [
    (["WIND", "WIND[S1]", "WIND[S2]"], [["speed"], ["WS"], ["VelN", "VelE"]]),
    (["NKF2[*]", "XKF2[*]", "XKFS[*]", "EKF2[*]", "EKF3[*]"], [["VWN", "VWE"]]),
    (["WIND_COV", "WIND_COV[S1]"], [["wind_x", "wind_y"]]),
    (["AHR2[S1]", "AHR2"], [["wind_spd"], ["wind_vel"], ["wind_speed"]]),
]
#: The fields of an EV message that can hold the event's number, in order.
EVENT_FIELDS = ["Id", "Event"]


def mode_spans(modes: DataFrame, last_end: Column) -> DataFrame:
    """modes(log_id, t, seq, name, ..) -> (log_id, name, start_t, end_t): a mode lasts until the next; the last one
    until last_end (an expression over its row)."""
    following = F.lead("t").over(Window.partitionBy("log_id").orderBy("t", "seq"))
    return modes.withColumn("end_t", F.coalesce(following, last_end)).select("log_id", "name", F.col("t").alias("start_t"), "end_t")


def log_mode_spans(modes: DataFrame) -> DataFrame:
    """modes(log_id, kind, copter, t, seq, mode, log_end) -> (log_id, name, start_t, end_t).

    The last mode of a binary or text log lasts until the log's end, a second at least; that of a telemetry link ("link")
    ten seconds.  Modes of binary logs are named by table, others by their text.
    """
    name = F.when(F.col("kind") == "binary", mode_name(F.col("mode"), F.col("copter"))).otherwise(F.col("mode"))
    last_end = F.when(F.col("kind") == "link", F.col("t") + 10).otherwise(F.greatest(F.col("log_end"), F.col("t") + 1))
    return mode_spans(modes.withColumn("name", name), last_end)


def first_spans(spans: DataFrame, most: int = 100) -> DataFrame:
    """The first spans of each log in order, so many at most."""
    place = F.row_number().over(Window.partitionBy("log_id").orderBy("start_t", "end_t", "name"))
    return spans.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def mode_changes(heartbeats: DataFrame) -> DataFrame:
    """heartbeats(log_id, sysid, t, seq, mode): system 1 only, no unknown modes, each only where it differs from the
    one before."""
    known = heartbeats.where((F.col("sysid") == 1) & ~F.col("mode").startswith("Mode("))
    before = F.lag("mode").over(Window.partitionBy("log_id").orderBy("t", "seq"))
    return known.withColumn("before", before).where("before is null or before <> mode").drop("before")


def armed_spans(states: DataFrame, keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """states(keys, t, seq, armed boolean) -> (keys, start_t, end_t, duration): from the first armed sample to the first
    disarmed one after it, or the last sample; half a second or less is left out."""
    w = Window.partitionBy(*keys).orderBy("t", "seq")
    edge = F.col("armed") & ~F.coalesce(F.lag("armed").over(w), F.lit(False))
    runs = states.withColumn("next_t", F.coalesce(F.lead("t").over(w), F.col("t"))).withColumn("run", F.sum(F.when(edge, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.where("armed").groupBy(*keys, "run").agg(F.min("t").alias("start_t"), F.max("next_t").alias("end_t"))
    return spans.withColumn("duration", F.col("end_t") - F.col("start_t")).where(F.col("duration") > SHORTEST_S).drop("run")


def event_spans(events: DataFrame, keys: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """events(keys, t, id) -> (keys, start_t, end_t, duration): each arming lasts until the first disarming after
    it, else until the last event; spans may overlap."""
    micros = events.select(*keys, "t", "id", F.round(F.col("t") * 1e6).cast("long").alias("us"))
    # downwards in time, so that the frame grows by one row at a time; a disarming at the same time is not later
    after = Window.partitionBy(*keys).orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, -1)
    ends = micros.withColumn("end_t", F.coalesce(F.min(F.when(F.col("id") == DISARM, F.col("t"))).over(after), F.max("t").over(Window.partitionBy(*keys))))
    spans = ends.where(F.col("id") == ARM).select(*keys, F.col("t").alias("start_t"), "end_t")
    return spans.withColumn("duration", F.col("end_t") - F.col("start_t")).where(F.col("duration") > SHORTEST_S)


def first_source(*sources: DataFrame) -> DataFrame:
    """(log_id, start_t, end_t, duration, source): of each log the spans of the first of the sources that has any, and
    there of the message that comes first.  sources(log_id, start_t, end_t, duration, source, rank)."""
    parts = [s.select("log_id", "start_t", "end_t", "duration", "source", F.struct(F.lit(k).alias("kind"), F.col("rank").cast("int").alias("rank"), "source").alias("order")) for k, s in enumerate(sources)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.withColumn("best", F.min("order").over(Window.partitionBy("log_id"))).where("order = best").drop("order", "best")


def heartbeat_rank(message: Column) -> Column:
    """System 1 first, then other systems, then messages without one."""
    return F.when(message.contains("[S1]"), 0).when(message.contains("[S"), 1).otherwise(2)


def _message_spans(states: DataFrame) -> DataFrame:
    """states(log_id, msg_type, source, rank, t, seq, armed): the armed spans of each message of each log."""
    return armed_spans(states, ("log_id", "msg_type", "source", "rank")).drop("msg_type")


def heartbeat_spans(fields: DataFrame) -> DataFrame:
    """fields(log_id, msg_type, field, seq, t, v) -> (log_id, source, rank, start_t, end_t, duration): from bit 128 of
    base_mode, of each HEARTBEAT message; fractions of a value are cut off."""
    beats = fields.where(F.col("msg_type").startswith("HEARTBEAT") & (F.col("field") == "base_mode"))
    armed = F.coalesce(F.col("v").try_cast("long").bitwiseAND(ARMED_BIT) != 0, F.lit(False))
    source = F.concat("msg_type", F.lit(".base_mode"))
    return _message_spans(beats.select("log_id", "msg_type", source.alias("source"), heartbeat_rank(F.col("msg_type")).alias("rank"), "t", "seq", armed.alias("armed")))


def _first_field(fields: DataFrame, message: str, names: list[str]) -> DataFrame:
    """The rows of the first of some fields that each message whose name begins with `message` has."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("field"))
    some = fields.where(F.col("msg_type").startswith(message) & (place > 0)).withColumn("place", place)
    return some.withColumn("first", F.min("place").over(Window.partitionBy("log_id", "msg_type"))).where("place = first")


def state_spans(fields: DataFrame) -> DataFrame:
    """The same of each STAT message, from the first of its fields Armed, Arm and ArmState: whole values above 0."""
    armed = F.coalesce(F.col("v").try_cast("long") > 0, F.lit(False))
    return _message_spans(_first_field(fields, "STAT", STATE_FIELDS).select("log_id", "msg_type", F.concat("msg_type", F.lit(".Armed")).alias("source"), F.lit(0).alias("rank"), "t", "seq", armed.alias("armed")))


def event_message_spans(fields: DataFrame) -> DataFrame:
    """The same of each EV message, from its field Id, else Event: arming and disarming numbers; fractions are cut off."""
    found = _first_field(fields, "EV", EVENT_FIELDS)
    events = found.select("log_id", F.concat("msg_type", F.lit(".Id (10/11)")).alias("source"), F.lit(0).alias("rank"), "t", F.col("v").try_cast("long").alias("id"))
    return event_spans(events, ("log_id", "source", "rank"))


def all_armed_spans(fields: DataFrame) -> DataFrame:
    """Heartbeats before states before arming events; fields(log_id, msg_type, field, seq, t, v).

    Of several messages of one kind the first in order of rank, then of letters, that has a span is taken (a catalog in a log's own order may have another
    first).  The spans of each kind are stored: all three are by log, so else one task would hold the sorts and windows of all of them at once.
    """
    return first_source(*(stored(found(fields), "spans") for found in (heartbeat_spans, state_spans, event_message_spans)))


def wind_speeds(fields: DataFrame) -> DataFrame:
    """fields(log_id, msg_type, field, seq, t, v) -> (log_id, t, seq, speed, source): of each log's first wind source.

    Sources come in the order of WIND_SOURCES: by kind, then by message with its instance, then by field; of the instances of an "[*]" message the
    first in order of letters.  Two components give their magnitude.
    """
    have = fields.groupBy("log_id", "msg_type").agg(F.collect_set("field").alias("have"))
    rank, names = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
    ways = [(message, parts) for messages, every in WIND_SOURCES for message in messages for parts in every]
    for k, (message, parts) in reversed(list(enumerate(ways))):
        bare = message.removesuffix("[*]")
        named = F.col("msg_type") == bare
        if bare != message:
            named |= F.col("msg_type").startswith(f"{bare}[")
        fits = named & F.array_contains("have", parts[0]) & F.array_contains("have", parts[-1])
        rank, names = F.when(fits, k).otherwise(rank), F.when(fits, F.array(*map(F.lit, parts))).otherwise(names)
    best = have.select("log_id", "msg_type", rank.alias("rank"), names.alias("parts")).where("rank is not null")
    best = best.groupBy("log_id").agg(F.min(F.struct("rank", "msg_type", "parts")).alias("b")).select("log_id", "b.msg_type", "b.parts")
    rows = fields.join(best, ["log_id", "msg_type"]).where(F.array_contains("parts", F.col("field")))
    speed = F.when(F.size(F.first("parts")) == 1, F.first("v")).otherwise(F.sqrt(F.sum(F.col("v") * F.col("v"))))
    source = F.concat(F.first("msg_type"), F.lit("."), F.array_join(F.first("parts"), "/"))
    return rows.groupBy("log_id", "msg_type", "seq", "t").agg(speed.alias("speed"), source.alias("source")).drop("msg_type")


def wind_stats(winds: DataFrame, spans: DataFrame) -> DataFrame:
    """(log_id, wind_source, wind_mean, wind_max) over armed samples, or all of a log without armed ones; NaN and
    negative speeds are left out, and logs without others have no row."""
    flying = inside_spans(winds.withColumn("series", F.col("source")).withColumn("v", F.col("speed")), spans)
    good = flying.where("speed >= 0 and not isnan(speed)")
    return good.groupBy("log_id").agg(F.first("source").alias("wind_source"), F.avg("speed").alias("wind_mean"), F.max("speed").alias("wind_max"))


def flight_totals(spans: DataFrame, *more: Column) -> DataFrame:
    """(log_id, flights, longest, longest_start, armed_total): the first of the longest flights; more: other aggregates over them."""
    return spans.groupBy("log_id").agg(F.count("*").alias("flights"), F.max("duration").alias("longest"), F.min_by("start_t", F.struct((-F.col("duration")).alias("d"), "start_t")).alias("longest_start"), F.sum("duration").alias("armed_total"), *more)


def log_summary(samples: DataFrame, spans: DataFrame, winds: DataFrame) -> DataFrame:
    """One row per log: duration, arming source, flights, longest, armed_total, wind source, mean and max.

    Spans, winds and their means are stored, so that each is made once and no task holds the sorts of all steps at once.
    """
    spans, winds = stored(spans, "spans"), stored(winds, "winds")
    totals = flight_totals(spans, F.first("source").alias("arming_source"))
    out = total_duration(samples).join(totals, "log_id", "left").join(stored(wind_stats(winds, spans), "wind"), "log_id", "left")
    return out.select("log_id", F.col("total").alias("duration"), F.coalesce("arming_source", F.lit("none")).alias("arming_source"), F.coalesce("flights", F.lit(0)).alias("flights"), "longest", F.coalesce("armed_total", F.lit(0.0)).alias("armed_total"), F.coalesce("wind_source", F.lit("None")).alias("wind_source"), "wind_mean", "wind_max")
