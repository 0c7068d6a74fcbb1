"""Identity of a payment across runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paidup.functions.dates import iso_text
from paidup.functions.text import normal
from paidup.schemas import MONEY


def payment_fingerprint(description: Column, amount: Column, value_date: Column) -> Column:
    """First 16 hex digits of SHA-1 over ``DESCRIPTION|amount|date``.

    Null when the amount or the date is missing, so such a payment never equals a ledger row.
    """
    text = F.concat(
        normal(F.coalesce(description, F.lit(""))),
        F.lit("|"),
        amount.cast(MONEY).cast("string"),
        F.lit("|"),
        iso_text(value_date),
    )
    return F.left(F.sha1(text), F.lit(16))
