"""Angles in degrees, and the unwrapping of phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.operators.series import SERIES, in_order, so_far


def wrap_180(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def wrap_360(x: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def turn_fix(step: Column) -> Column:
    """What makes a step of an angle (degrees) the short way round; 0 for steps below half a turn and for none."""
    short = F.pmod(step + 180.0, F.lit(360.0)) - 180.0
    short = F.when((short == -180.0) & (step > 0), 180.0).otherwise(short)
    return F.coalesce(F.when(F.abs(step) < 180.0, 0.0).otherwise(short - step), F.lit(0.0))


def unwrap(samples: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """samples with v (degrees) made continuous: a step over half a turn is taken the short way round."""
    turned = samples.withColumn("fix", turn_fix(F.col("v") - F.lag("v").over(in_order(keys))))
    return turned.withColumn("v", F.col("v") + F.sum("fix").over(so_far(keys))).drop("fix")
