"""Calendar days: epoch to day, stored day strings to dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_FORMAT = "yyyyMMdd"

_UNITS_PER_DAY = {"s": 86_400, "ms": 86_400_000}

# 0001-01-01 and 9999-12-31, counted from 1970-01-01
_FIRST_DAY, _LAST_DAY = -719_162, 2_932_896


def epoch_day(epoch: Column, unit: str = "s") -> Column:
    """UTC day (DATE) of an epoch in seconds or milliseconds.

    Whole-day arithmetic, so the answer does not depend on the session time zone. An epoch outside
    the years 1 to 9999, as of a corrupt record or another unit, gives NULL, and so does NaN.
    """
    days = epoch.cast("double") / F.lit(_UNITS_PER_DAY[unit])
    known = (days >= F.lit(_FIRST_DAY)) & (days < F.lit(_LAST_DAY + 1))
    return F.date_from_unix_date(F.when(known, F.floor(days).cast("int")))


def day_key(day: Column) -> Column:
    """The ``yyyyMMdd`` string under which stage files store a day."""
    return F.date_format(day, DAY_FORMAT)


def as_date(df: DataFrame, name: str, fmt: str = DAY_FORMAT) -> Column:
    """Column ``name`` of ``df`` as DATE, whether stored as a date or as a day string.

    A malformed day string gives NULL.
    """
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_date(F.col(name), fmt)
    return F.col(name).cast("date")


def date_literal(day: str | date) -> Column:
    """DATE literal from a ``date`` or a ``yyyy-MM-dd`` string."""
    return F.lit(day if isinstance(day, date) else date.fromisoformat(day))
