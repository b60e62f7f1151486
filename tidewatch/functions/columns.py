"""Row-level column functions. All of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOGIT_CLIP = 1e-6
SCORE_CLIP = 1e-8
ROUND_TOLERANCE = 1e-8


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the order key of every history frame."""
    return F.unix_micros(ts.cast("timestamp"))


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def differs(left: Column, right: Column) -> Column:
    """1 if the two differ; two nulls are equal, a null and a value are not."""
    return (~left.eqNullSafe(right)).cast("int")


def is_round(amount: Column, unit: float = 1000.0) -> Column:
    """1 if the floored remainder is zero up to the tolerance."""
    return (F.abs(F.pmod(amount, F.lit(unit))) <= F.lit(ROUND_TOLERANCE)).cast("int")


def finite_or_zero(value: Column) -> Column:
    as_double = value.cast("double")
    bad = value.isNull() | F.isnan(as_double) | (F.abs(as_double) == F.lit(float("inf")))
    return F.when(bad, F.lit(0)).otherwise(value)


def is_missing(name: str, dtype: str) -> Column:
    """Null, or NaN in a floating-point column."""
    null = F.col(name).isNull()
    return null | F.isnan(F.col(name)) if dtype in ("double", "float") else null


def clip(value: Column, margin: float) -> Column:
    return F.least(F.greatest(value, F.lit(margin)), F.lit(1.0 - margin))


def logit(p: Column) -> Column:
    clipped = clip(p, LOGIT_CLIP)
    return F.log(clipped / (F.lit(1.0) - clipped))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def unfused(value: Column) -> Column:
    """The same value, in a projection that Spark doesn't fuse with the steps before and after it.

    Spark fuses a chain of narrow steps into one generated method, and the JVM interprets a method of more than 8,000 bytes for good
    instead of compiling it. A function with a lambda isn't fused, so a chain over wide rows can be cut at it.
    """
    return F.get(F.transform(F.array(value), lambda x: x), F.lit(0))
