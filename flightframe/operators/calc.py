"""Calculated series: arithmetic, norms, angles, vibration, user expressions; results are samples of series CALC.*."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.functions import expressions
from flightframe.functions.angles import unwrap, wrap_180
from flightframe.operators import scans
from flightframe.operators.align import high_rate_rows, interpolate, low_rate_pair
from flightframe.operators.series import SERIES, runs_begin


def _divided(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit("NaN").cast("double")).otherwise(a / F.nullif(b, F.lit(0.0)))


OPERATORS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divided}


def named(rows: DataFrame, name: str) -> DataFrame:
    """rows(log_id, seq, t, v) as samples of CALC.name."""
    return rows.select("log_id", F.lit(f"CALC.{name}").alias("series"), "seq", "t", "v")


def two_series(samples: DataFrame, a: str, op: str, b: str) -> DataFrame:
    """a op b at the times of the lower-rate series; division by zero gives NaN."""
    pair = low_rate_pair(samples, a, b)
    return named(pair.withColumn("v", OPERATORS[op](F.col("va"), F.col("vb"))), f"{a}{op}{b}")


def with_constant(samples: DataFrame, a: str, op: str, k: float) -> DataFrame:
    """a op k; k must be a number; division by zero gives NaN throughout."""
    k = float(k)
    return named(samples.where(F.col("series") == a).withColumn("v", OPERATORS[op](F.col("v"), F.lit(k))), f"{a}{op}{k:g}")


def norm(samples: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Root of the sum of squares at the times of the highest-rate field."""
    rows = high_rate_rows(samples, fields).groupBy("log_id", "t", "seq").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))
    return named(rows, "norm")


def vector_magnitude(wide: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """wide with the magnitude of some of its columns; a missing column is an error."""
    missing = [c for c in columns if c not in wide.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return wide.withColumn(out, F.sqrt(sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))))


def mapped(samples: DataFrame, a: str, name: str, function) -> DataFrame:
    """A column function over one series: wrap_180, wrap_360, degrees, radians."""
    return named(samples.where(F.col("series") == a).withColumn("v", function(F.col("v"))), f"{name}({a})")


def angle_difference(samples: DataFrame, a: str, b: str | float) -> DataFrame:
    """a - b in [-180, 180): the side that is interpolated is unwrapped first; b may be a constant."""
    if not isinstance(b, str):
        return named(samples.where(F.col("series") == a).withColumn("v", wrap_180(F.col("v") - float(b))), f"ang_sub({a})")
    two = samples.where(F.col("series").isin(a, b))
    counts = two.groupBy("log_id").agg(F.count_if(F.col("series") == a).alias("na"), F.count_if(F.col("series") == b).alias("nb")).where("na > 0 and nb > 0")
    sided = two.join(counts.select("log_id", F.when(F.col("na") < F.col("nb"), a).otherwise(b).alias("base")), "log_id")
    smooth = unwrap(sided.where("series <> base"))
    rows = interpolate(sided.where("series = base").select("log_id", "t", "seq", "series", "v"), smooth.select("log_id", "t", "v"))
    difference = F.when(F.col("series") == a, F.col("v") - F.col("other")).otherwise(F.col("other") - F.col("v"))
    return named(rows.withColumn("v", wrap_180(difference)), f"ang_sub({a},{b})")


def vibration(samples: DataFrame, floor_hz: float = 5.0, vibe_hz: float = 2.0, keys: Sequence[str] = SERIES) -> DataFrame:
    """samples with v as vibration level: the square of what a first low-pass leaves, through a second one, per series.

    Series come one after the other in order of time and are filtered by Arrow batches, all of a batch at once; the
    filters' values go on from batch to batch, so a series may be longer than any batch.  The first value is 0.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t_last, level_last, state_last, second = None, 0.0, 0.0, 0.0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = runs_begin(batch, keys)
            goes_on = last == tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = not goes_on
            t, y = (np.asarray(batch.column(c).fill_null(np.nan), float) for c in ("t", "v"))
            dt = np.maximum(np.diff(t, prepend=t_last), 1e-6)
            slow, quick = (dt / (dt + 1 / (2 * np.pi * hz)) for hz in (floor_hz, vibe_hz))
            level = low_pass(y, np.where(new, 1.0, slow), level_last)
            square = (y - level) ** 2
            seconds = np.append(goes_on and second, new[:-1])  # their square is where the second filter starts
            state = low_pass(square, np.where(new | seconds, 1.0, quick), state_last)
            out = np.sqrt(np.maximum(np.where(new, 0.0, state), 0.0))
            last, t_last, level_last, state_last, second = tuple(batch.column(k)[-1].as_py() for k in keys), t[-1], level[-1], state[-1], bool(new[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out) if c == "v" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    ordered = samples.withColumn("v", F.col("v").cast("double")).repartition(*keys).sortWithinPartitions(*keys, "t", "seq")
    return ordered.mapInArrow(run, ordered.schema)


def long_vibration(samples: DataFrame, floor_hz: float = 5.0, vibe_hz: float = 2.0, keys: Sequence[str] = SERIES, parts: int | None = None) -> DataFrame:
    """vibration of series of any length, spread over tasks.

    A low-pass makes each value an affine map (keep, add) of the one before, and maps of neighbours compose to one.  So each
    piece of a series is first one map; applied in order they give each piece the value it begins with.  That is done for
    the first filter, then, with its values known, for the second.
    """
    import numpy as np
    import pyarrow as pa

    marks = (*keys, scans.PIECE)
    order = ["t", "seq"]
    plain = samples.withColumn("v", F.col("v").cast("double"))
    columns = plain.columns
    cut = scans.pieces(plain, order, keys, parts)
    rows = scans.with_previous(scans.numbered(cut, order, keys), "t", "__before", order, keys)

    def filtered(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[tuple]:
        """Of each batch where pieces begin, the factors of the filter asked for, its values, and the rows' numbers."""
        piece, level_end, state_end = None, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = runs_begin(batch, marks)
            new[0] = piece != tuple(batch.column(k)[0].as_py() for k in marks)
            t, y, before, level, state = (np.asarray(batch.column(c).fill_null(np.nan), float) for c in ("t", "v", "__before", "__level", "__state"))
            row, dt = np.asarray(batch.column("row")), np.maximum(t - before, 1e-6)

            def run(x, hz: float, settled: int, begins, ended: float) -> tuple:
                """A filter that takes over its input up to row `settled`; a piece begins with the value given for it, or goes on."""
                rate = np.where(row <= settled, 1.0, dt / (dt + 1 / (2 * np.pi * hz)))
                factor, add = 1 - rate, rate * x
                start = np.where(new, begins, 0.0)  # noqa: B023
                start[0] = begins[0] if new[0] else ended  # noqa: B023
                starts = new | (np.arange(len(x)) == 0)  # noqa: B023
                taken = starts & (factor != 0)
                add[taken] += factor[taken] * start[taken]
                return factor, affine(np.where(starts, 0.0, factor), add)

            factor, values = run(y, floor_hz, 0, level, level_end)
            level_end = values[-1]
            if second:
                factor, values = run((y - values) ** 2, vibe_hz, 1, state, state_end)
                state_end = values[-1]
            piece = tuple(batch.column(k)[-1].as_py() for k in marks)
            yield batch, new, factor, values, row

    def as_maps(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, kinds = None, None
            for batch, new, factor, values, _ in filtered(batches, second):
                kinds, done = [batch.schema.field(k).type for k in marks], []
                starts = np.flatnonzero(new | (np.arange(len(new)) == 0))
                for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True):
                    keep, add = float(factor[low:high].prod()), float(values[high - 1])
                    if new[low]:
                        if held:
                            done.append(held)
                        held = (*(batch.column(k)[low].as_py() for k in marks), keep, add)
                    else:
                        held = (*held[:-2], held[-2] * keep, add)
                yield maps(done, kinds)
            if held:
                yield maps([held], kinds)

        def maps(found: list, kinds: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate([*kinds, pa.float64(), pa.float64()])], [*marks, "keep", "add"])

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, values, row in filtered(batches, True):
            out = np.sqrt(np.maximum(np.where(row == 0, 0.0, values), 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(out) if c == "v" else batch.column(c) for c in columns], columns)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*marks).sortWithinPartitions(*marks, *order)

    def with_start(rows: DataFrame, second: bool, name: str) -> DataFrame:
        """rows with the value that a piece begins with: the maps of the pieces before it, one after the other, from 0."""
        maps = dealt(rows).mapInArrow(as_maps(second), rows.select(*marks).schema.add("keep", "double").add("add", "double"))
        earlier = F.collect_list(F.struct("keep", "add")).over(Window.partitionBy(*keys).orderBy(scans.PIECE).rowsBetween(Window.unboundedPreceding, -1))
        value = F.aggregate(earlier, F.lit(0.0), lambda h, m: F.when(m["keep"] == 0, m["add"]).otherwise(m["keep"] * h + m["add"]))
        begins = maps.select(*(F.col(k).alias(f"__{k}") for k in marks), value.alias("__begins"))
        same = F.lit(True)
        for k in marks:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        return scans.stored(rows.join(begins, same, "left").withColumn(name, F.col("__begins")).drop("__begins", *(f"__{k}" for k in marks)), "filters")

    levelled = with_start(rows.withColumns({"__level": F.lit(0.0), "__state": F.lit(0.0)}), False, "__level")
    return dealt(with_start(levelled, True, "__state")).mapInArrow(finish, plain.schema)


def affine(keep, add):
    """h[i] = keep[i] * h[i - 1] + add[i], h[-1] = 0; in log2(n) steps, each of which doubles the number of values behind a position
    that are summed up.  Where keep is 0 nothing before counts, not even NaN."""
    import numpy as np

    keep, h = keep.copy(), add.copy()
    step = 1
    while step < len(h):
        earlier = np.where(keep[step:] == 0, 0.0, keep[step:] * np.where(keep[step:] == 0, 0.0, h[:-step]))
        keep = np.concatenate((keep[:step], keep[step:] * keep[:-step]))
        h = np.concatenate((h[:step], h[step:] + earlier))
        step *= 2
    return h


def low_pass(x, rate, before: float):
    """h[i] = h[i - 1] + rate[i] * (x[i] - h[i - 1]), h[-1] = before."""
    add = rate * x
    add[0] += (1 - rate[0]) * before if rate[0] != 1 else 0.0
    return affine(1 - rate, add)


def vibration_magnitude(samples: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(log_id, t, seq, a column per field, vibe_mag): vibration of each axis at the times of the highest-rate one."""
    axes = vibration(high_rate_rows(samples, fields).withColumnRenamed("field", "series").select("log_id", "series", "seq", "t", "v"))
    wide = axes.groupBy("log_id", "t", "seq").pivot("series", list(fields)).agg(F.first("v"))
    return vector_magnitude(wide, list(fields), "vibe_mag")


#: Messages whose times a constant takes, in order.
CONSTANT_TIMES = ["ATT", "POS", "GPS", "BARO", "IMU"]


def expression(samples: DataFrame, text: str, name: str) -> DataFrame:
    """A user's expression (functions.expressions) over series of one log, combined by position.

    The names of series are found in the text, longer ones first, so GPS.Alt is not found in GPS.AltMSL.  Times are those of the longest
    name (the first in order of letters on ties); positions that not all of them have, and logs without one of them, are left out.  A text without a series
    has its value at the times of the first message of CONSTANT_TIMES that the log has, else of its first message in order of letters.
    A name without a dot becomes CALC.name.  A text that is no expression raises ValueError before any job starts, one with unknown
    names when the names of series are known.
    """
    expressions.parsed(text)
    found = [r["series"] for r in samples.select("series").distinct().where(F.contains(F.lit(text), F.col("series"))).collect()]  # substrings of the text
    short, names = expressions.with_places(text, found)
    value = expressions.as_column(short, {f"series_{k}": F.col(f"series_{k}") for k in range(len(names))})
    full = name if "." in name else f"CALC.{name}"
    if not names:
        message = F.substring_index("series", ".", 1)
        rank = F.array_position(F.array(*map(F.lit, CONSTANT_TIMES)), message)
        first = samples.groupBy("log_id").agg(F.min(F.struct(F.when(rank == 0, len(CONSTANT_TIMES) + 1).otherwise(rank).alias("rank"), message.alias("message"), "series")).alias("f")).select("log_id", F.col("f.series").alias("series"))
        return samples.join(first, list(SERIES), "left_semi").select("log_id", F.lit(full).alias("series"), "seq", "t", value.alias("v"))
    numbered = scans.numbered(scans.pieces(samples.where(F.col("series").isin(names)).select(*SERIES, "seq", "t", F.col("v").cast("double").alias("v")), ["t", "seq"]), ["t", "seq"])
    cells = [F.first(F.when(F.col("series") == s, F.struct("v")), True).alias(f"cell_{k}") for k, s in enumerate(names)]
    wide = numbered.groupBy("log_id", "row").agg(*cells, *(F.first(F.when(F.col("series") == names[0], F.col(c)), True).alias(c) for c in ("t", "seq")))
    whole = wide.where(" and ".join(f"cell_{k} is not null" for k in range(len(names))))
    rows = whole.select("log_id", "seq", "t", *(F.col(f"cell_{k}.v").alias(f"series_{k}") for k in range(len(names))))
    return rows.select("log_id", F.lit(full).alias("series"), "seq", "t", value.alias("v"))
