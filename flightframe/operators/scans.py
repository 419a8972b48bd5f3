"""Windows over series that are longer than a task: running values, neighbours, row numbers and medians in two passes.

Rows are dealt by ranges of (keys, order) into pieces, so a long series lies in several pieces that follow one another and
short series share one.  The first pass sums each piece up to one row a series, the states of earlier pieces are
combined in order, and the second pass works inside pieces with what came before handed in.  No task gets more than a piece,
and only states, a row per series and piece, meet by series.

Pieces are stored once, since ranges are drawn from a sample: both passes must see the same ones.  Values that compare equal in
the order given to `pieces` are never parted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flightframe.operators.series import SERIES
from flightframe.sources.store import stored

PIECE = "__piece"


def pieces(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = SERIES, parts: int | None = None) -> DataFrame:
    """rows with __piece int, ascending in (keys, order); parts: how many, by default those of a shuffle."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *keys, *order).withColumn(PIECE, F.spark_partition_id()), "pieces")


def inside(order: Sequence[str | Column], keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys, PIECE).orderBy(*order)


def handed_in(rows: DataFrame, states: dict[str, tuple[Column, Callable[[str], Column]]], keys: Sequence[str] = SERIES, down: bool = False) -> DataFrame:
    """rows with a column for each state(aggregate over a piece, how those of earlier pieces are combined); null where no piece
    of the series comes before.  down: from the last piece to the first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(PIECE) if down else PIECE)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, PIECE).agg(*(aggregate.alias(name) for name, (aggregate, _) in states.items()))
    ahead = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(PIECE).alias("__of"), *(combine(name).over(before).alias(name) for name, (_, combine) in states.items()), F.row_number().over(order).alias("__nth"))
    # pieces follow one another in order of keys, so no more rows than pieces have one of their series before them
    ahead = F.broadcast(ahead.where("__nth > 1").drop("__nth"))
    same = F.col(PIECE) == F.col("__of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(ahead, same, "left").drop("__of", *(f"__{k}" for k in keys))


def latest(name: str) -> Column:
    """Of states the last that is not null."""
    return F.last(name, True)


def numbered(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Pieces with row, from 0 in each series."""
    counted = handed_in(rows, {"__before": (F.count("*"), F.sum)}, keys)
    return counted.withColumn("row", F.row_number().over(inside(order, keys)) - 1 + F.coalesce("__before", F.lit(0))).drop("__before")


def with_previous(rows: DataFrame, column: str, name: str, order: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Pieces with the value that the row before has in a column, across pieces."""
    place = F.struct(*order)
    end = F.max_by(F.struct(F.col(column).alias("x")), place)
    known = handed_in(rows, {"__end": (end, latest)}, keys)
    w = inside(order, keys)
    return known.withColumn(name, F.when(F.row_number().over(w) == 1, F.col("__end.x")).otherwise(F.lag(column).over(w))).drop("__end")


def running_sum(rows: DataFrame, column: str, order: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Pieces with a column replaced by its running sum; nulls count as none."""
    known = handed_in(rows, {"__sum": (F.sum(column), F.sum)}, keys)
    local = F.sum(column).over(inside(order, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.coalesce(F.col("__sum"), F.lit(0)) + F.coalesce(local, F.lit(0))
    return known.withColumn(column, total).drop("__sum")


def filled(rows: DataFrame, columns: Sequence[str], order: str, keys: Sequence[str] = SERIES, down: bool = False, names: Sequence[str] | None = None) -> DataFrame:
    """Pieces with the last value of each column that is not null, at or before a row (down: at or after); rows of one place see each
    other's.  names: of the filled columns, by default their own."""
    names = names or columns
    bare = lambda c: F.col(f"`{c}`")
    pick = F.min_by if down else F.max_by
    states = {f"__fill{i}": (pick(bare(c), F.when(bare(c).isNotNull(), F.col(order))), latest) for i, c in enumerate(columns)}
    known = handed_in(rows, states, keys, down)
    w = inside([F.desc(order) if down else F.col(order)], keys).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = known.withColumns({n: F.coalesce(F.last(bare(c), True).over(w), F.col(f"__fill{i}")) for i, (c, n) in enumerate(zip(columns, names, strict=True))})
    return out.drop(*states)


def medians(rows: DataFrame, column: str, keys: Sequence[str] = SERIES, parts: int | None = None) -> DataFrame:
    """(keys, median) of the values that are not null, exactly: by rank over pieces sorted by value, so a series of any length is
    spread over tasks and only the rows of one or two ranks of a series meet."""
    values = rows.select(*keys, F.col(column).alias("__value")).where("__value is not null")
    ranked = numbered(pieces(values, ["__value"], keys, parts), ["__value"], keys)
    sizes = ranked.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count("*").alias("__n"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    middle = F.col("row").isin(F.expr("(__n - 1) div 2"), F.expr("__n div 2"))
    return ranked.join(sizes, same).where(middle).groupBy(*keys).agg(F.avg("__value").alias("median"))


def with_dt(samples: DataFrame, keys: Sequence[str] = SERIES, parts: int | None = None) -> DataFrame:
    """series.with_dt for series of any length: pieces with row, dt and median_dt."""
    order = ["t", "seq"]
    steps = with_previous(numbered(pieces(samples, order, keys, parts), order, keys), "t", "__previous", order, keys)
    steps = stored(steps.withColumn("dt", F.col("t") - F.col("__previous")).drop("__previous"), "steps")  # read three times
    middle = medians(steps.where("dt > 0"), "dt", keys, parts).select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("median").alias("median_dt"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return steps.join(middle, same, "left").drop(*(f"__{k}" for k in keys))


def unwrapped(samples: DataFrame, keys: Sequence[str] = SERIES, parts: int | None = None) -> DataFrame:
    """angles.unwrap for series of any length."""
    from flightframe.functions.angles import turn_fix

    order = ["t", "seq"]
    steps = with_previous(pieces(samples, order, keys, parts), "v", "__previous", order, keys)
    turns = running_sum(steps.withColumn("__fix", turn_fix(F.col("v") - F.col("__previous"))), "__fix", order, keys)
    return turns.withColumn("v", F.col("v") + F.col("__fix")).drop("__previous", "__fix", PIECE)
