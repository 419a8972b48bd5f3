"""Windows over samples: time steps, medians, first and last."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("log_id", "series")


def in_order(keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t", "seq")


def whole(keys: Sequence[str] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys)


def so_far(keys: Sequence[str] = SERIES) -> WindowSpec:
    return in_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_dt(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """samples with row (from 0), dt to the row before, and the median of the positive dt of the series.

    One shuffle: both windows share the partitioning.
    """
    w = in_order(keys)
    steps = samples.withColumn("row", F.row_number().over(w) - 1).withColumn("dt", F.col("t") - F.lag("t").over(w))
    return steps.withColumn("median_dt", F.median(F.when(F.col("dt") > 0, F.col("dt"))).over(whole(keys)))


def not_nan(c: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def runs_begin(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """For each row of an Arrow batch whether its keys differ from those of the row before; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = np.asarray(batch.column(k).dictionary_encode(null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return new
