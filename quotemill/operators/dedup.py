"""One copy of each message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _ordered(df: DataFrame, order: Sequence[str]) -> Column:
    """A struct of delivery time and tie-break as one fixed-width value, so that min_by stays a hash aggregate; the struct itself for other types. Nulls come first."""
    kinds = [df.schema[c].dataType for c in order]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if len(order) == 1 and isinstance(kinds[0], (*whole, T.TimestampType, T.TimestampNTZType)):
        return F.col(order[0])
    if len(order) == 2 and isinstance(kinds[0], (T.TimestampType, T.TimestampNTZType)) and isinstance(kinds[1], whole):
        ts = F.col(order[0]).cast("timestamp")
        # Microseconds of any timestamp stay below 2**59, so both fit 38 digits.
        high, low = F.coalesce(F.unix_micros(ts), F.lit(-(2**60))), F.coalesce(F.col(order[1]).cast("bigint"), F.lit(-(2**63)))
        return (high.cast("decimal(19,0)") * F.expr("18446744073709551616BD")).cast("decimal(38,0)") + low.cast("decimal(19,0)")
    return F.struct(*order)


def _kept(keyed: DataFrame, names: Sequence[str], key: str, order: Column) -> DataFrame:
    """The key of each identity's first row. A mergeable aggregate: every task reduces its own copies before the shuffle, so an identity that holds a third of all rows costs one row a task."""
    return keyed.groupBy(*names).agg(F.min_by(key, order).alias(key)).select(key)


def keep_one(df: DataFrame, identity: dict[str, Column], order: Sequence[str], key: str | None = None) -> DataFrame:
    """The row of each identity that comes first by order; all columns of df come back unchanged.

    With key, a unique column, only identity, order and key are aggregated (a hash aggregate where order
    is fixed-width) and the rows follow by a semi-join on the key, which can't be skewed; payloads
    never meet a sort of the aggregate. Without it the aggregate carries whole rows. Rows with a null in
    any part of the identity (or in the key) can't be known for copies and are all kept. order must tell
    rows apart (end it with a unique column); of rows that are equal in all of it any one is kept. Nulls
    come first in order. Columns of df may have any names.
    """
    names = [f"_k{i}" for i in range(len(identity))]
    if key is not None:
        known = _all([c.isNotNull() for c in [*identity.values(), F.col(key)]])
        keyed = df.filter(known).select(F.col(key).alias("_key"), *[c.alias(n) for n, c in zip(names, identity.values())], _ordered(df, order).alias("_order"))
        kept = _kept(keyed, names, "_key", F.col("_order"))
        return df.filter(known).join(kept, F.col(key) == F.col("_key"), "left_semi").unionByName(df.filter(~known))
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in zip(names, identity.values())], F.struct(*order).alias("_order"))
    known = _all([F.col(n).isNotNull() for n in names])
    kept = keyed.filter(known).groupBy(*names).agg(F.min_by("_row", "_order").alias("_row"))
    return kept.select("_row.*").unionByName(keyed.filter(~known).select("_row.*"))


def surplus_copies(df: DataFrame, identity: dict[str, Column], key: str, order: Sequence[str] | None = None) -> DataFrame:
    """The keys of all rows that keep_one would drop; key must be unique.

    Two shuffles: one of (identity, key), reduced map-side, and one of the keys alone, to which the
    kept keys are anti-joined. Keys are unique, so neither side can be skewed however hot an
    identity is, and no list of copies is ever gathered. Rows with a null in the identity are no
    copies, rows with a null key have no name and are left out. With no order the smallest key is kept:
    keys that number the deliveries are time and tie-break at once.
    """
    names = [f"_k{i}" for i in range(len(identity))]
    keyed = df.select(key, _ordered(df, list(order or [key])).alias("_order"), *[c.alias(n) for n, c in zip(names, identity.values())]).filter(_all([F.col(n).isNotNull() for n in [*names, key]]))
    return keyed.select(key).join(_kept(keyed, names, key, F.col("_order")), key, "left_anti")
