"""Labelled folds and bounded samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def sample(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, the same ones each time: those whose hash of doc_id is lowest.

    Of many more rows only those with hashes in the range that is expected to hold four times as many are sorted, so
    that what tasks send on does not grow with their number.
    """
    n = ids.count()
    if n > 4 * most:
        ids = ids.where(F.xxhash64("doc_id") < -(1 << 63) + (4 * most << 64) // n)
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
