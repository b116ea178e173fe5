"""Connected components for event ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import Stored


def labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each node of an edge with the smallest node it is connected to: node, label.

    Large stars link a node's larger neighbours to the smallest node in reach, small stars the smaller
    ones; the edges shrink to one star a component (Kiveris and others, 2014). Each round is written to
    the shared folder and compared with the last by count and checksum. Nulls and self loops link
    nothing.
    """
    u, v = F.col(a), F.col(b)
    state = Stored(edges.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("x"), F.least(u, v).alias("y")).distinct())
    seen = None
    while True:
        both = state.df.unionByName(state.df.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").distinct()
        large = Stored(large)
        down = large.df.groupBy("x").agg(F.min("y").alias("m"))
        small = large.df.join(down, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(down.select("x", F.col("m").alias("y"))).filter("x != y").distinct()
        after = Stored(small)
        large.drop()
        state.drop()
        state = after
        mark = tuple(state.df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return state.df.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(state.df.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())


def group_ids(members: DataFrame, group: str, member: str) -> DataFrame:
    """An id for each group made of its members: group, group_id = 'evt_' and ten hex digits of the md5 of its distinct members, sorted and joined by '|'. A group's members are gathered in one row."""
    joined = F.array_join(F.array_sort(F.collect_set(member)), "|")
    return members.groupBy(group).agg(F.concat(F.lit("evt_"), F.substring(F.md5(joined), 1, 10)).alias("group_id"))
