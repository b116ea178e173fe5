"""Odds and prices as probabilities, as column expressions. Null in, null out; what no odds can be gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _inside(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), p)


def american(odds: Column) -> Column:
    return F.when(odds > 0, 100 / F.nullif(odds + 100, F.lit(0.0))).when(odds < 0, odds / F.nullif(odds - 100, F.lit(0.0)))


def decimal(odds: Column) -> Column:
    return F.when(odds > 1, 1 / F.nullif(odds, F.lit(0.0)))


def cents(price: Column) -> Column:
    return _inside(price / 100)


def share(price: Column) -> Column:
    return _inside(price)


def without_margin(a: Column, b: Column) -> Column:
    """The probability of the first of two outcomes whose quoted probabilities add up to more than 1."""
    return F.try_divide(a, a + b)


def in_open_unit(p: Column) -> Column:
    """The probability if it lies inside (0, 1), else null."""
    return _inside(p)
