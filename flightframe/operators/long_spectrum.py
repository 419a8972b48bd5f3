"""Amplitude spectra of series that are longer than a task.

A transform of n = a * b values is a transforms of columns, factors, and transforms of rows: the values are dealt by column, b short
transforms of length a are taken, each value gets its factor, the values are dealt by row, and a transforms of length b are taken.  Lengths without
two balanced divisors become a convolution with a chirp, which is three transforms of a power of two.  No task needs more than a batch of
columns or rows, whose length is about the root of the series'.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.operators import scans
from flightframe.operators.series import SERIES, runs_begin
from flightframe.operators.spectrum import joined
from flightframe.sources.store import stored

#: The longest row that is transformed in one piece, relative to the root of the length; a longer one calls for a power of two.
UNBALANCED = 16


def short_transforms(rows: DataFrame, keys: Sequence[str], order: str, inverse: bool = False) -> DataFrame:
    """rows(keys, order, re, im, ..) with re and im as the transform of the values of each key, at places order = 0, 1, ..; other columns stay with their place."""
    columns = rows.columns
    turn = np.fft.ifft if inverse else np.fft.fft

    def done(part: pa.RecordBatch) -> pa.RecordBatch:
        starts = np.flatnonzero(runs_begin(part, keys))
        values = np.asarray(part.column("re"), float) + 1j * np.asarray(part.column("im"), float)
        size = np.diff(np.append(starts, len(values)))
        for n in np.unique(size):
            at = starts[size == n][:, None] + np.arange(n)
            values[at] = turn(values[at], axis=1)
        new = {"re": pa.array(np.ascontiguousarray(values.real)), "im": pa.array(np.ascontiguousarray(values.imag))}
        return pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in columns], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = runs_begin(batch, keys)
            new[0] = bool(waiting) and any(waiting[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
            cut = int(np.flatnonzero(new)[-1]) if new.any() else -1
            if cut >= 0:
                yield done(joined([*waiting, batch.slice(0, cut)]))
                waiting = []
            waiting.append(batch.slice(max(cut, 0)))
        if waiting:
            yield done(joined(waiting))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, rows.schema)


def four_step(rows: DataFrame, keys: Sequence[str], inverse: bool = False) -> DataFrame:
    """rows(keys, a, b, j long, re, im) with j = 0 .. a * b - 1 -> the same columns with the transform of each key, j as the place in it."""
    columns = rows.columns
    dealt = rows.withColumn("high", F.expr("j div b")).withColumn("low", F.expr("j % b"))
    first = short_transforms(dealt, [*keys, "low"], "high", inverse)
    angle = F.lit((2 if inverse else -2) * np.pi) * ((F.col("high") * F.col("low")) % (F.col("a") * F.col("b"))) / (F.col("a") * F.col("b"))
    turned = first.withColumns({"re": F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), "im": F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)})
    second = short_transforms(turned, [*keys, "high"], "low", inverse)
    return second.withColumn("j", F.col("high") + F.col("low") * F.col("a")).select(*columns)


def _chirp(j: Column, n: Column, sign: int) -> tuple[Column, Column]:
    angle = F.lit(sign * np.pi) * ((j * j) % (2 * n)) / n
    return F.cos(angle), F.sin(angle)


def chirped(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows(keys, n, j, re, im) -> the transform of each key, of any length, as a convolution of a power of two."""
    half = F.ceil(F.log2((2 * F.col("n") - 1).cast("double")) / 2).cast("int")
    sized = rows.withColumn("a", F.pow(F.lit(2.0), half).cast("long")).withColumn("b", F.col("a"))
    c, s = _chirp(F.col("j"), F.col("n"), -1)
    values = sized.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})
    lengths = stored(sized.select(*keys, "n", "a", "b").distinct(), "lengths")
    places = lengths.select(*keys, "n", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("a") * F.col("b") - 1)).alias("j"))
    near = F.least(F.col("j"), F.col("a") * F.col("b") - F.col("j"))
    cc, cs = _chirp(near, F.col("n"), 1)
    inside = near < F.col("n")
    both = places.withColumns({"re": F.when(inside, cc).otherwise(0.0), "im": F.when(inside, cs).otherwise(0.0), "side": F.lit(1)})
    zero = places.join(values.select(*keys, "j"), [*keys, "j"], "left_anti").withColumns({"re": F.lit(0.0), "im": F.lit(0.0), "side": F.lit(0)})
    sides = both.unionByName(zero).unionByName(values.withColumn("side", F.lit(0)).select(*both.columns))
    turned = stored(four_step(sides, [*keys, "side"]), "turned")
    x, y = (turned.where(F.col("side") == k).select(*keys, "n", "a", "b", "j", F.col("re").alias(f"re{k}"), F.col("im").alias(f"im{k}")) for k in (0, 1))
    product = x.join(y, [*keys, "n", "a", "b", "j"]).select(*keys, "n", "a", "b", "j", (F.col("re0") * F.col("re1") - F.col("im0") * F.col("im1")).alias("re"), (F.col("re0") * F.col("im1") + F.col("im0") * F.col("re1")).alias("im"))
    back = four_step(product, keys, inverse=True).where("j < n")
    return back.select(*keys, "n", "j", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))


def long_spectrum(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """spectrum.spectrum for series of any length: samples(keys, t, seq, v, fs) -> (keys, bin int, freq, mag).

    Keys must not be null.  A null value makes all of its series' amplitudes NaN, as NaN does.
    """
    order = ["t", "seq"]
    plain = samples.select(*keys, "t", "seq", F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v"), F.col("fs").cast("double").alias("fs"))
    numbered = scans.numbered(scans.pieces(plain, order, keys), order, keys)
    facts = numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min_by("fs", F.when(F.col("row") == 0, F.col("row"))).alias("rate"))
    divisor = F.array_max(F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n"))), lambda d: F.col("n") % d == 0))
    facts = stored(facts.withColumn("a", divisor).withColumn("b", F.expr("n div a")).withColumn("none", (F.col("n") < 2) | ~F.coalesce(F.col("rate") > 0, F.lit(False))), "facts")
    single = facts.where("none").select(*keys, F.lit(0).alias("bin"), F.lit(0.0).alias("freq"), F.lit(0.0).alias("mag"))
    window = 0.5 - 0.5 * F.cos(2 * np.pi * F.col("row") / (F.col("n") - 1))
    rows = numbered.join(facts.where("not none"), list(keys)).select(*keys, "n", "a", "b", F.col("row").cast("long").alias("j"), ((F.col("v") - F.col("mean")) * window).alias("re"), F.lit(0.0).alias("im"))
    rows = stored(rows, "windowed")
    even = F.col("b") <= UNBALANCED * F.ceil(F.sqrt("n"))
    turned = four_step(rows.where(even), keys).select(*keys, "n", "j", "re", "im").unionByName(chirped(rows.where(~even).drop("a", "b"), keys))
    found = turned.where("j <= n div 2").join(facts.select(*keys, "rate"), list(keys))
    return found.select(*keys, F.col("j").cast("int").alias("bin"), (F.col("j") * F.col("rate") / F.col("n")).alias("freq"), (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * 2 / F.col("n")).alias("mag")).unionByName(single)
