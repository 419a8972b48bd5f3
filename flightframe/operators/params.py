"""Parameters: last values, differences between logs, searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_values(params: DataFrame) -> DataFrame:
    """params(log_id, name, seq, value) -> (log_id, name, value): the last one in file order."""
    return params.groupBy("log_id", "name").agg(F.max_by("value", "seq").alias("value"))


def param_names(params: DataFrame) -> DataFrame:
    """(name): the distinct names over all logs."""
    return params.select("name").distinct()


def values_differ(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """One is missing, numbers apart by more than the tolerance, or other texts than equal ones; NaN equals NaN."""
    x, y = a.try_cast("double"), b.try_cast("double")
    numbers = x.isNotNull() & y.isNotNull()
    apart = F.when(F.isnan(x) & F.isnan(y), False).when(F.isnan(x) | F.isnan(y), False).otherwise(F.abs(x - y) > tolerance)
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).when(numbers, apart).otherwise(F.trim(a) != F.trim(b))


def param_diff(params: DataFrame, labels: Sequence[str], only_diff: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """params(label, name, value) -> (name, a column per label, differs): compared with the first label."""
    wide = params.groupBy("name").pivot("label", list(labels)).agg(F.first("value"))
    first = F.col(f"`{labels[0]}`")
    differs = F.lit(False)
    for other in labels[1:]:
        differs = differs | values_differ(first, F.col(f"`{other}`"), tolerance)
    rows = wide.withColumn("differs", differs)
    return rows.where("differs") if only_diff else rows


def diff_counts(rows: DataFrame) -> DataFrame:
    """(compared, differing) of param_diff(.., only_diff=False)."""
    return rows.agg(F.count("*").alias("compared"), F.count_if("differs").alias("differing"))


def search(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column contains text, whatever the case."""
    return rows.where(F.upper(column).contains(text.upper()))
