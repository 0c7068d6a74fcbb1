"""Money expressions: exact decimals, and whole cents where sums are compared in bulk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paidup.functions.text import strip
from paidup.schemas import MONEY


def parse_money(text: Column) -> Column:
    """Decimal amount of a text field, null when it is not a number."""
    return strip(text.cast("string")).try_cast(MONEY)


def parse_int(text: Column) -> Column:
    """Whole number of a text field (``12`` or ``12.0``), null when it is not one."""
    return strip(text.cast("string")).try_cast("decimal(20,2)").try_cast("int")


def cents(amount: Column) -> Column:
    """A decimal(18,2) as whole cents. Four of them always fit a long when added."""
    return (amount.cast(MONEY) * 100).cast("long")


def currency_text(amount: Column) -> Column:
    """``$1,234,567``, or a dash for a missing amount."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(amount, 0)), F.lit("—"))
