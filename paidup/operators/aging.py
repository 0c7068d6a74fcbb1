"""Days overdue and aging bands."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paidup.config import BAND_NAMES, BANDS
from paidup.functions.dates import cutoff_date
from paidup.functions.labels import band_position


def days_overdue(due_date: Column, cutoff: dt.date) -> Column:
    return F.datediff(F.lit(cutoff), due_date)


def aging_band(days: Column) -> Column:
    """Band of a number of days; a missing number falls through to the open-ended band."""
    chain = F
    for name, last in BANDS[:-1]:
        chain = chain.when(days <= last, name)
    return chain.otherwise(BANDS[-1][0])


def with_aging(items: DataFrame, cutoff: dt.date | str | None = None) -> DataFrame:
    """Add ``days_overdue`` and ``aging_band`` as of the cutoff date."""
    day = cutoff_date(cutoff)
    return items.withColumn("days_overdue", days_overdue(F.col("due_date"), day)).withColumn(
        "aging_band", aging_band(F.col("days_overdue"))
    )


def band_table(spark: SparkSession) -> DataFrame:
    """The fixed bands with their order of severity."""
    return spark.createDataFrame([(i, name) for i, name in enumerate(BAND_NAMES)], "band_ord int, aging_band string")


def worst_band(band: Column) -> Column:
    """Aggregate: the most severe band of a group, the mildest when there is none."""
    names = F.array(*[F.lit(name) for name in BAND_NAMES])
    return F.element_at(names, F.coalesce(F.max(band_position(band)), F.lit(0)) + 1)
