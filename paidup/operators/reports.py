"""Reports over the consolidated invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.config import EXCEPTION_STATES
from paidup.functions.labels import band_position, priority_position
from paidup.operators.aging import band_table, worst_band

DETAIL_COLUMNS = (
    "client",
    "document",
    "due_date",
    "days_overdue",
    "open_amount",
    "aging_band",
    "invoice_state",
    "priority",
    "origin",
)


def unpaid(base: DataFrame) -> DataFrame:
    return base.filter(~F.col("is_paid"))


def portfolio_summary(open_items: DataFrame) -> DataFrame:
    """One row: invoices, distinct clients, open balance."""
    return open_items.agg(
        F.count(F.lit(1)).alias("invoices"),
        F.countDistinct("client_norm").alias("clients"),
        F.sum("open_amount").alias("open_balance"),
    )


def kpis(base: DataFrame) -> DataFrame:
    """One row of headline figures, in one pass."""
    open_ = ~F.col("is_paid")
    critical = open_ & (F.col("priority") == "CRITICO")
    zero = F.lit(0).cast("decimal(28,2)")
    return base.agg(
        F.coalesce(F.sum(F.when(open_, F.col("open_amount"))), zero).alias("open_balance"),
        F.count_if(open_).alias("open_invoices"),
        F.coalesce(F.sum(F.when(critical, F.col("open_amount"))), zero).alias("critical_balance"),
        F.count_if(critical).alias("critical_invoices"),
        F.count_if("is_paid").alias("invoices_with_payment"),
    )


def critical_summary(base: DataFrame) -> DataFrame:
    """Count and balance of critical invoices, paid ones included."""
    return base.filter(F.col("priority") == "CRITICO").agg(
        F.count(F.lit(1)).alias("critical_invoices"),
        F.coalesce(F.sum("open_amount"), F.lit(0).cast("decimal(28,2)")).alias("critical_balance"),
    )


def aging_distribution(items: DataFrame) -> DataFrame:
    """Invoices and balance per band: every band is present, in order of severity."""
    per_band = items.groupBy("aging_band").agg(
        F.count("document").alias("invoices"), F.sum("open_amount").alias("balance")
    )
    return (
        band_table(items.sparkSession)
        .join(per_band, "aging_band", "left")
        .select(
            "band_ord",
            "aging_band",
            F.coalesce("invoices", F.lit(0)).alias("invoices"),
            F.coalesce("balance", F.lit(0).cast("decimal(28,2)")).alias("balance"),
        )
        .orderBy("band_ord")
    )


def open_clients(base: DataFrame) -> DataFrame:
    """Clients with unpaid invoices, most overdue first."""
    return (
        unpaid(base)
        .groupBy("client")
        .agg(
            F.count("document").alias("invoices"),
            F.sum("open_amount").alias("open_balance"),
            F.max("days_overdue").alias("max_days_overdue"),
            worst_band(F.col("aging_band")).alias("worst_band"),
        )
        .orderBy(F.desc_nulls_last("max_days_overdue"), "client")
    )


def critical_top(base: DataFrame, n: int = 10) -> DataFrame:
    """The most overdue critical invoices."""
    return (
        base.filter(F.col("priority") == "CRITICO")
        .orderBy(F.desc("days_overdue"), "document")
        .select("client", "document", "open_amount", "days_overdue")
        .limit(n)
    )


def filter_detail(
    base: DataFrame,
    client: str | None = None,
    priority: str | None = None,
    invoice_state: str | None = None,
    aging_band: str | None = None,
) -> DataFrame:
    """Keep the rows that meet every filter given."""
    wanted = {"client": client, "priority": priority, "invoice_state": invoice_state, "aging_band": aging_band}
    for column, value in wanted.items():
        if value is not None:
            base = base.filter(F.col(column) == value)
    return base


def detail(base: DataFrame) -> DataFrame:
    """The invoice list: most urgent priority first, most overdue first within it."""
    return base.orderBy(
        priority_position(F.col("priority")), F.desc_nulls_last("days_overdue"), "document", "item_ord"
    ).select(*DETAIL_COLUMNS)


def option_lists(base: DataFrame) -> DataFrame:
    """Values offered by the filters: list name, position for fixed orders, value."""

    def values(name: str, column: str, order):
        return base.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct().select(
            F.lit(name).alias("list"), order(F.col("value")).cast("int").alias("ord"), "value"
        )

    alphabetic = lambda _: F.lit(0)
    lists = (
        values("client", "client", alphabetic)
        .unionByName(values("priority", "priority", priority_position))
        .unionByName(values("invoice_state", "invoice_state", alphabetic))
        .unionByName(values("aging_band", "aging_band", band_position))
    )
    return lists.orderBy("list", "ord", "value")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column, for a filter list."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def exception_counts(exceptions: DataFrame) -> DataFrame:
    """Exceptions per state, in the fixed order of the states; absent states are left out."""
    order = F.array_position(F.array(*[F.lit(s) for s in EXCEPTION_STATES]), F.col("match_state"))
    return (
        exceptions.groupBy("match_state").agg(F.count(F.lit(1)).alias("rows")).orderBy(order)
    )


def omitted_payments(history: DataFrame) -> DataFrame:
    """One row: history rows of runs before the last one."""
    per_run = history.groupBy("run_at").agg(F.count(F.lit(1)).alias("rows"))
    return per_run.agg(
        (F.coalesce(F.sum("rows"), F.lit(0)) - F.coalesce(F.max_by("rows", "run_at"), F.lit(0))).alias("omitted")
    )
