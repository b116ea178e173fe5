"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet: name, with underscores after it if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of those names, in any case: what an operator adds replaces them."""
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.lower() in {n.lower() for n in names}])


def stripped(text: Column) -> Column:
    """The text without outer white space of any kind."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")
