"""Date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from paidup.config import MONTHS_ES
from paidup.functions.text import strip


def statement_date(text: Column) -> Column:
    """``YYYYMMDD`` text as a date, null when invalid."""
    return F.try_to_date(strip(text.cast("string")), "yyyyMMdd")


def day_first_date(text: Column) -> Column:
    """Day-first or ISO date text as a date, decided per row; null when neither fits."""
    value = strip(text.cast("string"))
    day = F.substring_index(value, " ", 1)
    return F.coalesce(
        F.try_to_date(day, "d/M/yyyy"), F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(day, "d-M-yyyy")
    )


def as_date(value: dt.date | dt.datetime | str | None) -> dt.date | None:
    """A Python argument as a date."""
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def cutoff_date(value: dt.date | dt.datetime | str | None = None) -> dt.date:
    """The reference date of a run: the argument, or today, fixed once on the driver."""
    return as_date(value) or dt.date.today()


def iso_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def long_spanish_date(day: Column) -> Column:
    """``09 de mayo de 2026``."""
    months = F.array(*[F.lit(name) for name in MONTHS_ES])
    return F.format_string("%02d de %s de %d", F.dayofmonth(day), F.element_at(months, F.month(day)), F.year(day))
