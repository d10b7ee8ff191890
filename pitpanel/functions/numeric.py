"""Numbers under one policy: null is missing, and no NaN or infinity leaves an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
HOUR = 3600


def finite(x: Column) -> Column:
    """x, or null where it isn't a finite number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(x: Column) -> Column:
    """Numeric text as double; null and what isn't a number are null."""
    return finite(x.try_cast("double"))


def ratio(a: Column, b: Column, least: float = EPS) -> Column:
    return F.when(F.abs(b) >= least, a / b)


def smaller(a: Column, b: Column) -> Column:
    """Null if either is, unlike ``least``."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).when(x == 0, 0.0)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def gate(x: Column, by: Column, on: Column) -> Column:
    """x where ``on``, else 0; null where ``by`` is."""
    return F.when(by.isNotNull(), F.when(on, x).otherwise(0.0))


def divide_up(a: Column, b: int) -> Column:
    """Whole quotient rounded up, of integers."""
    return -F.floor(-a / F.lit(b))


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, truncated; for timestamps with or without zone."""
    return F.unix_timestamp(ts.cast("timestamp"))


def iso_epoch(text: Column) -> Column:
    """ISO 8601 text, ``Z`` or an offset or none (then UTC), as epoch seconds; else null."""
    return F.unix_timestamp(F.try_to_timestamp(text))
