"""Registration of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The samples view of events, as in sources/events.py.
SAMPLES = """samples as (
    select user_id as log_id, event_type as series, event_id as seq, epoch_us(ts) / 1e6 as t, value as v, cast(json_extract_string(props, '$.k') as bigint) as k
    from events)"""
#: The same with field names.
FIELDS = """rows as (
    select log_id, series as msg_type, f as field, series || '.' || f as series, seq, t, v, k
    from (select *, ['Lat', 'Lng', 'Alt', 'AccX', 'AccY', 'AccZ', 'Roll', 'I'][k % 8 + 1] as f from samples))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """To some decimals, without negative zeros."""
    return F.round(c, digits) + F.lit(0.0)


def rounded_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})
