"""Flow and category of bank movements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paidup.config import (
    CATEGORY_RULES,
    CUSTOMER_PAYMENT,
    FLOW_CREDIT,
    FLOW_DEBIT,
    FLOW_NONE,
    OTHER_OUTFLOW,
    CategoryRule,
)


def flow_of(amount: Column) -> Column:
    """Credit, debit, or neither for zero and missing amounts."""
    return F.when(amount > 0, FLOW_CREDIT).when(amount < 0, FLOW_DEBIT).otherwise(FLOW_NONE)


def category_of(description: Column, flow: Column, rules: Sequence[CategoryRule] = CATEGORY_RULES) -> Column:
    """One ``when`` chain: the first rule whose flow fits and whose keyword occurs decides."""
    chain = F
    for rule in rules:
        hit = reduce(or_, [F.contains(description, F.lit(word)) for word in rule.keywords])
        if rule.flow is not None:
            hit = (flow == rule.flow) & hit
        chain = chain.when(hit, rule.category)
    return chain.when(flow == FLOW_CREDIT, CUSTOMER_PAYMENT).otherwise(OTHER_OUTFLOW)


def classify(movements: DataFrame, rules: Sequence[CategoryRule] = CATEGORY_RULES) -> DataFrame:
    """Add ``category``."""
    return movements.withColumn("category", category_of(F.col("description"), F.col("flow"), rules))


def customer_payments(movements: DataFrame) -> DataFrame:
    """Rows of the category. The filter is on a generated column, so that it stays above the category: pushed below, it
    would hold the whole expression of a derived text once for every keyword."""
    own = movements.withColumn("category", F.explode(F.array("category")))
    return own.filter(F.col("category") == CUSTOMER_PAYMENT)


def in_date_range(movements: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Inclusive range on ``value_date``; rows without a date go only when a bound is set."""
    return movements.filter(date_mask(date_from, date_to))


def date_mask(date_from=None, date_to=None) -> Column:
    from paidup.functions.dates import as_date

    mask = F.lit(True)
    if date_from is not None or date_to is not None:
        mask = F.col("value_date").isNotNull()
    if date_from is not None:
        mask = mask & (F.col("value_date") >= F.lit(as_date(date_from)))
    if date_to is not None:
        mask = mask & (F.col("value_date") <= F.lit(as_date(date_to)))
    return mask


def date_filter_counts(movements: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """One row: movements kept and discarded by the filter, and how many had no valid date."""
    kept = date_mask(date_from, date_to)
    return movements.agg(
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("discarded"),
        F.count_if(F.col("value_date").isNull()).alias("without_date"),
    )


def movement_summary(movements: DataFrame) -> DataFrame:
    """One row: size, date range and flow counts of a statement."""
    return movements.agg(
        F.count(F.lit(1)).alias("movements"),
        F.min("value_date").alias("first_date"),
        F.max("value_date").alias("last_date"),
        F.count_if(F.col("flow") == FLOW_CREDIT).alias("credits"),
        F.count_if(F.col("flow") == FLOW_DEBIT).alias("debits"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)
