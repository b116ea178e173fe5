"""Latest rows, first and last copies, and keyed appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions.columns import fresh


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole row of each key that comes first in order (give it descending, ending with a unique column).

    Catalyst limits each task's groups to one row before the shuffle, so hot keys cost a row a task.
    Null keys are a key of their own.
    """
    rn = fresh(df, "_rn")
    return df.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rn) == 1).drop(rn)


def last_values(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """For each key and column the last value that isn't null (or NaN): columns may come from different rows. Of equal times the largest value is taken."""
    def last(c: str) -> Column:
        v = F.col(c)
        there = v.isNotNull() & ~F.isnan(v) if dict(df.dtypes)[c] in ("double", "float") else v.isNotNull()
        return F.max(F.when(there, F.struct(F.col(order).alias("o"), v.alias("v"))))["v"].alias(c)

    return df.groupBy(*keys).agg(*[last(c) for c in columns])


def at_latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows that carry the latest time of their key. The latest times are a map-side reduced aggregate, joined back."""
    top = df.groupBy(*keys).agg(F.max(order).alias("_top"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col(f"d.{order}") == F.col("t._top")]
    return df.alias("d").join(top.alias("t"), on, "left_semi")


def keep_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with the same keys the one of the earliest part, then the first in order."""
    part = "_part"
    for p in parts:
        part = fresh(p, part)
    stacked = parts[0].withColumn(part, F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        stacked = stacked.unionByName(p.withColumn(part, F.lit(i)), allowMissingColumns=True)
    return latest_row(stacked, keys, [F.col(part).asc(), *order]).drop(part)


def keep_last(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with the same keys the one of the latest part, then the first in order."""
    return keep_first(list(parts)[::-1], keys, order)


def append_new(log: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The log with the new rows whose key it doesn't have yet; within the batch the first in order. A null key is never new twice: such rows are left out."""
    fresh = latest_row(new.filter(F.col(key).isNotNull()), [key], order).join(log.select(key), key, "left_anti")
    return log.unionByName(fresh, allowMissingColumns=True)
