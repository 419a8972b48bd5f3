"""Joins in time: interpolation, outer timestamp join, fill, pairing, nearest rows, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.operators import scans
from flightframe.operators.series import SERIES


def interpolate(base: DataFrame, other: DataFrame, keys: Sequence[str] = ("log_id",), long: bool = False) -> DataFrame:
    """base(keys, t, ..) with other: the value of other(keys, t, v) at each time, end values held outside its range.

    One shuffle: both sides are put into one table, and the neighbours of a base row come from two running windows
    (up and down in time; a window that looks forward would be recomputed for every row).  long: the table is dealt by ranges of
    time too, and neighbours in other pieces are handed in.
    """
    columns = [c for c in base.columns if c not in keys and c != "t"]
    left = base.select(*keys, "t", F.struct(*columns, F.lit(True).alias("__base")).alias("row"), F.lit(None).cast("struct<t:double,v:double>").alias("point"))
    right = other.select(*keys, "t", F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.struct("t", "v").cast("struct<t:double,v:double>").alias("point"))
    up = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if long:
        both = scans.pieces(left.unionByName(right), ["t"], keys)
        both = scans.filled(scans.filled(both, ["point"], "t", keys, names=["a"]), ["point"], "t", keys, down=True, names=["b"])
    else:
        both = left.unionByName(right).withColumn("a", F.last("point", True).over(up)).withColumn("b", F.last("point", True).over(down))
    slope = (F.col("b.v") - F.col("a.v")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
    value = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")), F.col("a.v")).otherwise(slope * (F.col("t") - F.col("a.t")) + F.col("a.v"))
    return both.where("row is not null").select(*keys, "t", *(F.col(f"row.{c}").alias(c) for c in columns), value.alias("other"))


def low_rate_pair(samples: DataFrame, a: str, b: str, long: bool = False) -> DataFrame:
    """(log_id, t, seq, va, vb) of logs that have both: the series with fewer samples gives the times (on a tie b)."""
    two = samples.where(F.col("series").isin(a, b))
    counts = two.groupBy("log_id").agg(F.count_if(F.col("series") == a).alias("na"), F.count_if(F.col("series") == b).alias("nb")).where("na > 0 and nb > 0")
    sided = two.join(counts.select("log_id", F.when(F.col("na") < F.col("nb"), a).otherwise(b).alias("base")), "log_id")
    rows = interpolate(sided.where("series = base").select("log_id", "t", "seq", "series", "v"), sided.where("series <> base").select("log_id", "t", "v"), long=long)
    first = F.col("series") == a
    return rows.select("log_id", "t", "seq", F.when(first, F.col("v")).otherwise(F.col("other")).alias("va"), F.when(first, F.col("other")).otherwise(F.col("v")).alias("vb"))


def high_rate_rows(samples: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(log_id, t, seq, field, v): every field at the times of the longest one (the first listed on ties); only logs
    that have all fields."""
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("series"))
    some = samples.where(F.col("series").isin(*fields))
    counts = some.groupBy(*SERIES).agg(F.count("*").alias("n"))
    base = counts.groupBy("log_id").agg(F.count("*").alias("have"), F.max_by("series", F.struct("n", -place)).alias("base")).where(F.col("have") == len(fields)).select("log_id", "base")
    times = some.join(base, "log_id").where("series = base").select("log_id", "t", "seq")
    wanted = times.withColumn("series", F.explode(F.array(*map(F.lit, fields))))
    return interpolate(wanted, some.select(*SERIES, "t", "v"), SERIES).select("log_id", "t", "seq", F.col("series").alias("field"), F.col("other").alias("v"))


def xy_pairs(samples: DataFrame, x: str, y: str) -> DataFrame:
    """(log_id, t, seq, x, y): y at the times of x, for logs that have both."""
    have = samples.where(F.col("series") == y).select("log_id").distinct()
    base = samples.where(F.col("series") == x).join(have, "log_id", "left_semi").select("log_id", "t", "seq", F.col("v").alias("x"))
    return interpolate(base, samples.where(F.col("series") == y).select("log_id", "t", "v")).withColumnRenamed("other", "y")


def rounded_times(samples: DataFrame) -> DataFrame:
    """Times to 6 decimals, half to even; the first sample (in time and file order) of each series and time."""
    rounded = samples.withColumn("timestamp", F.bround("t", 6))
    return rounded.groupBy(*SERIES, "timestamp").agg(F.min_by("v", F.struct("t", "seq")).alias("v"))


def outer_join(samples: DataFrame, series: Sequence[str], fill: str = "none", long: bool = False) -> DataFrame:
    """(log_id, timestamp, a column per series): the union of the rounded times; missing is null or the value before.

    fill "ffill" carries values on per column (NaN too); gaps at the start stay null.
    """
    wide = rounded_times(samples).groupBy("log_id", "timestamp").pivot("series", list(series)).agg(F.first("v"))
    if fill == "ffill" and long:
        bare = wide.select("log_id", "timestamp", *(F.nanvl(F.col(f"`{s}`"), F.lit(None)).alias(s) for s in series))
        return scans.filled(scans.pieces(bare, ["timestamp"], ["log_id"]), series, "timestamp", ["log_id"]).drop(scans.PIECE)
    if fill == "ffill":
        w = Window.partitionBy("log_id").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        wide = wide.select("log_id", "timestamp", *(F.last(F.nanvl(F.col(f"`{s}`"), F.lit(None)), True).over(w).alias(s) for s in series))
    return wide


def occurrences() -> Column:
    """The place of a sample among those of its series and time, from 1."""
    return F.row_number().over(Window.partitionBy(*SERIES, "t").orderBy("seq"))


def time_shapes(samples: DataFrame) -> DataFrame:
    """(log_id, series, n, h): the number and a hash of a series' times; those of equal times in order are equal.

    Times in order are told by how often each comes, so no task needs a whole series.
    """
    return samples.withColumn("row", occurrences()).groupBy(*SERIES).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row", "t")).alias("h"))


def equal_times(samples: DataFrame) -> DataFrame:
    """(log_id, equal boolean): whether all series of a log have the same times in the same order."""
    return time_shapes(samples).groupBy("log_id").agg(((F.count_distinct("n") == 1) & (F.count_distinct("h") == 1)).alias("equal"))


def side_by_side(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    """(log_id, row, timestamp, a column per series) by position, without rounding or filling."""
    row = (F.row_number().over(Window.partitionBy(*SERIES).orderBy("t", "seq")) - 1).alias("row")
    numbered = samples.select("log_id", "series", "t", "v", row)
    return numbered.groupBy("log_id", "row").pivot("series", list(series)).agg(F.first("v")).join(numbered.groupBy("log_id", "row").agg(F.min("t").alias("timestamp")), ["log_id", "row"])


def inside_spans(samples: DataFrame, spans: DataFrame, long: bool = False) -> DataFrame:
    """samples inside any closed span(log_id, start_t, end_t) of their log; logs with none of that keep all samples.

    A sample is inside if the greatest end of the spans that have started reaches it, so overlapping spans cost nothing.
    Adds filtered boolean: whether the log was cut.  long: a log may be longer than a task.
    """
    starts = spans.select("log_id", F.col("start_t").alias("t"), F.col("end_t").alias("__end"))
    started = Window.partitionBy("log_id").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = samples.withColumn("__sample", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    if long:
        keys = ["log_id"]
        cut = scans.handed_in(scans.pieces(both, ["t"], keys), {"__ahead": (F.max("__end"), F.max)}, keys)
        here = F.max("__end").over(scans.inside(["t"], keys).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rows = cut.withColumn("__inside", F.coalesce(F.greatest(here, "__ahead") >= F.col("t"), F.lit(False))).where("__sample")
        found = rows.groupBy(F.col("log_id").alias("__log")).agg(F.max("__inside").alias("filtered"))
        marked = rows.join(found, F.col("log_id").eqNullSafe(F.col("__log")))
        return marked.where("__inside or not filtered").drop("__end", "__sample", "__inside", "__ahead", "__log", scans.PIECE)
    reached = F.coalesce(F.max("__end").over(started) >= F.col("t"), F.lit(False))
    marked = both.withColumn("__inside", reached).where("__sample").withColumn("filtered", F.max("__inside").over(Window.partitionBy("log_id")))
    return marked.where("__inside or not filtered").drop("__end", "__sample", "__inside")


def clipped_spans(spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """spans(log_id, name, start_t, end_t) shifted by their log's shift and cut to bounds(log_id, shift, low, high)."""
    moved = spans.join(bounds, "log_id").withColumn("start_t", F.col("start_t") + F.col("shift")).withColumn("end_t", F.col("end_t") + F.col("shift"))
    inside = moved.where("end_t >= low and start_t <= high")
    return inside.select("log_id", "name", F.greatest("start_t", "low").alias("start_t"), F.least("end_t", "high").alias("end_t"))


def nearest_message(messages: DataFrame, queries: DataFrame, long: bool = False) -> DataFrame:
    """messages(log_id, t, seq, text), queries(log_id, query, at) -> queries with the nearest message (times to 3
    decimals; the first on ties).  Only the neighbours on both sides are compared, found by running windows; long: over pieces of a log."""
    rows = messages.select("log_id", F.round("t", 3).alias("t"), F.struct(F.round("t", 3).alias("t"), "seq", "text").alias("m"), F.lit(None).cast("long").alias("query"))
    asked = queries.select("log_id", F.col("at").alias("t"), F.lit(None).cast(rows.schema["m"].dataType).alias("m"), "query")
    up = Window.partitionBy("log_id").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("log_id").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(asked)
    # of messages at one time the first in file order: the running maximum (minimum) of (t, -seq) ((t, seq))
    key = lambda sign: F.struct("m.t", (sign * F.col("m.seq")).alias("s"), "m.text")
    last, first = (F.when(F.col("m").isNotNull(), key(sign)) for sign in (-1, 1))
    if long:
        keys = ["log_id"]
        cut = scans.handed_in(scans.pieces(both, ["t"], keys), {"__up": (F.max(last), F.max)}, keys)
        cut = scans.handed_in(cut, {"__down": (F.min(first), F.min)}, keys, down=True)
        near_up, near_down = (scans.inside([t], keys).rangeBetween(Window.unboundedPreceding, Window.currentRow) for t in (F.col("t"), F.desc("t")))
        near = cut.withColumn("a", F.greatest(F.max(last).over(near_up), "__up")).withColumn("b", F.least(F.min(first).over(near_down), "__down")).where("m is null")
    else:
        near = both.withColumn("a", F.max(last).over(up)).withColumn("b", F.min(first).over(down)).where("m is null")
    da, db = F.abs(F.col("t") - F.col("a.t")), F.abs(F.col("b.t") - F.col("t"))
    before = F.col("b").isNull() | (F.col("a").isNotNull() & ((da < db) | ((da == db) & (-F.col("a.s") <= F.col("b.s")))))
    return near.select("log_id", "query", F.col("t").alias("at"), F.when(before, F.col("a.t")).otherwise(F.col("b.t")).alias("t"), F.when(before, -F.col("a.s")).otherwise(F.col("b.s")).alias("seq"), F.when(before, F.col("a.text")).otherwise(F.col("b.text")).alias("text"))


def stride(samples: DataFrame, most: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Every step-th row from the first, step = ceil(n / most), where a series has more than most rows; most 0: all."""
    if most <= 0:
        return samples
    w = Window.partitionBy(*keys)
    rows = samples.withColumn("__row", F.row_number().over(w.orderBy("t", "seq")) - 1).withColumn("__n", F.count("*").over(w))
    return rows.where((F.col("__n") <= most) | (F.col("__row") % F.ceil(F.col("__n") / most) == 0)).drop("__row", "__n")
