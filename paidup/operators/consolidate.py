"""Invoices with their payment, state, priority and origin; payments that need a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paidup.config import EXCEPTION_STATES
from paidup.functions.labels import origin_label
from paidup.functions.text import normal
from paidup.skew import lookup


def associated(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("match_state") == "ASOCIADO")


def applied_documents(matches: DataFrame) -> DataFrame:
    """One row per associated payment and document."""
    return associated(matches).select(
        F.explode(F.array_distinct("documents")).alias("document"), "client", "payment_id", "match_method", "value_date"
    )


def first_payments(matches: DataFrame, keys=("document",)) -> DataFrame:
    """The payment with the smallest id per document. ``min`` combines map-side, so a document
    paid very often costs one row per task."""
    first = F.min(F.struct("payment_id", "match_method", F.col("value_date").alias("payment_date")))
    return (
        applied_documents(matches)
        .withColumnRenamed("client", "client_norm")
        .groupBy(*keys)
        .agg(first.alias("first"))
        .select(*keys, "first.*")
    )


def _payments_by_client(open_items: DataFrame, matches: DataFrame) -> DataFrame:
    """First payments per client and document; a payment without a client counts for every client of its document."""
    keys = ["client_norm", "document"]
    client = normal(F.col("client"))
    blank = client.isNull() | (client == "")
    named = first_payments(matches.withColumn("client", client).filter(~blank), keys)
    unnamed = first_payments(matches.filter(blank))
    owners = open_items.select(*keys).distinct()
    both = named.unionByName(owners.join(unnamed, "document").select(*named.columns))
    first = F.min(F.struct("payment_id", "match_method", "payment_date")).alias("first")
    return both.groupBy(*keys).agg(first).select(*keys, "first.*")


def invoice_state(is_paid: Column, days: Column) -> Column:
    return F.when(is_paid, "PAGADA").when(days > 0, "VENCIDA").otherwise("AL_DIA")


def priority(is_paid: Column, days: Column) -> Column:
    """A paid invoice is settled only when it is not overdue; overdue ones keep their urgency."""
    return (
        F.when(is_paid & (days <= 0), "RESUELTO")
        .when(days > 60, "CRITICO")
        .when(days > 30, "ALTO")
        .when(days > 0, "MEDIO")
        .otherwise("BAJO")
    )


def consolidate_items(
    open_items: DataFrame, matches: DataFrame, join_on_client: bool = False, hot_documents=()
) -> DataFrame:
    """Receivables with the first payment applied to each document.

    Documents join by number alone, so one number under two clients is paid for both, unless
    ``join_on_client`` is set.
    """
    keys = ["client_norm", "document"] if join_on_client else ["document"]
    payments = _payments_by_client(open_items, matches) if join_on_client else first_payments(matches)
    joined = lookup(open_items, payments, keys, "left", hot_documents, ["item_ord"])
    paid, days = F.col("is_paid"), F.col("days_overdue")
    return (
        joined.withColumn("is_paid", F.col("payment_id").isNotNull())
        .withColumn("invoice_state", invoice_state(paid, days))
        .withColumn("priority", priority(paid, days))
        .withColumn("origin", origin_label(F.col("match_method")))
        .select(
            *open_items.columns, "payment_id", "match_method", "payment_date", "is_paid", "invoice_state", "priority", "origin"
        )
    )


def exceptions_of(matches: DataFrame) -> DataFrame:
    """Match results that wait for a person, with their origin label."""
    return matches.filter(F.col("match_state").isin(*EXCEPTION_STATES)).withColumn(
        "origin", origin_label(F.col("match_method"))
    )


def consolidate(open_items: DataFrame, matches: DataFrame, join_on_client: bool = False, hot_documents=()):
    """(consolidated invoices, exceptions)."""
    return consolidate_items(open_items, matches, join_on_client, hot_documents), exceptions_of(matches)
