"""Statistics of series in a time range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.operators.series import SERIES, not_nan


def range_stats(samples: DataFrame, low: float | None = None, high: float | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys, n, v_min, v_max, v_mean, v_std, v_last) of a closed time range; all but the last value skip NaN.

    A series without a row in the range has none in the result.
    """
    rows = samples if low is None or high is None else samples.where(F.col("t").between(low, high))
    x = not_nan(F.col("v"))
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("v_min"), F.max(x).alias("v_max"), F.avg(x).alias("v_mean"), F.stddev_pop(x).alias("v_std"), F.max_by("v", F.struct("t", "seq")).alias("v_last"))
