"""Distributed union-find: connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.shared import written


#: Rows of one node that one task may get in any case (under a megabyte); a node with more, a hub, is split.
LEAST_PART = 50_000
#: There are at most about twice as many hubs as this, so they are broadcast.
MOST_HUBS = 100_000


def with_lowest(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows(u, v) with m, the smallest v of each u.  Hubs are joined in parts: n_rows is the number of rows or more."""
    part = max(LEAST_PART, n_rows // MOST_HUBS)
    if n_rows <= part:
        return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
    lowest = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / part).cast("int")
    hubs = F.broadcast(lowest.where(F.col("n") > part).select(F.col("u").alias("hub"), parts.alias("parts")))
    dealt = rows.join(hubs, F.col("u") == F.col("hub"), "left").select("u", "v", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("part"))
    return dealt.join(lowest.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["u", "part"]).select("u", "v", "m")


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node long, root long), root = the smallest node of the component.

    Alternates two rounds that hang every node below the smallest neighbour it knows ("large star" for larger
    neighbours, "small star" for smaller ones) until the forest is flat; the number of rounds grows with the logarithm
    of the longest chain.  A round is two aggregations with map-side minima and two joins; a node with very many links
    (a hub) is joined in parts.  Each round is written to the shared folder, and replaces the one before.
    Nodes without a link to another node have no row.  Null ends and self links are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(spark, edges, "links")
    before, n = None, edges.count()
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_lowest(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        small = with_lowest(large, n).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = written(spark, small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "stars", edges)
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == before:
            break
        before, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
