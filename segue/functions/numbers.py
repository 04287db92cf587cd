"""Lenient casts: bad text becomes 0 or NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    # the JVM also reads "12d" and "12f"; those are not numbers here
    return F.when(~text.rlike("[dDfF]\\s*$"), text.try_cast("double"))


def lenient_double(text: Column) -> Column:
    return F.coalesce(_number(text), F.lit(0.0))


def lenient_int(text: Column) -> Column:
    """Whole part of a number text; anything unreadable is 0."""
    value = _number(text)
    return F.coalesce(
        F.when(F.isnan(value), F.lit(None)).otherwise(
            F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
        ).try_cast("int"),
        F.lit(0),
    )


def lenient_date(text: Column) -> Column:
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def leading_number(text: Column) -> Column:
    return F.coalesce(
        F.regexp_extract(text, r"^\s*([\d.]+)", 1).try_cast("double"), F.lit(0.0)
    )


def clock_seconds(text: Column) -> Column:
    """``ss``, ``mm:ss`` or ``hh:mm:ss`` (fractions allowed) to seconds; bad text is 0."""
    total = F.aggregate(
        F.transform(F.split(text, ":"), _number),
        F.lit(0.0),
        lambda acc, p: acc * 60 + p,
    )
    return F.coalesce(total, F.lit(0.0))


def sample_rate(text: Column) -> Column:
    """Hz from ``44100``, ``44.1`` or ``44.1k``."""
    value = leading_number(text)
    return (
        F.when((value > 0) & (value < 1000), F.bround(value * 1000)).otherwise(F.floor(value))
    ).cast("int")


def digits_only(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def nonzero(value: Column) -> Column:
    return F.when(value != 0, value)


def stars_from_255(value: Column) -> Column:
    return F.bround(value / 51).cast("int")


def clamp_stars(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), value)).cast("int")


def stars_to_255(value: Column) -> Column:
    return (clamp_stars(value) * 51).cast("int")


def half_even(value: Column) -> Column:
    """Nearest whole number, ties to even, as BIGINT."""
    return F.rint(value).cast("bigint")
