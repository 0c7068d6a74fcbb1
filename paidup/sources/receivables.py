"""Open receivables from an ERP export or a weekly sheet."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paidup.functions.dates import day_first_date
from paidup.functions.money import parse_money
from paidup.functions.text import strip, trailing_zero_dropped
from paidup.operators.aging import with_aging
from paidup.schemas import ERP_FILE_COLUMNS, MONEY, OPEN_ITEMS, WEEKLY_COLUMNS
from paidup.sources.ordinals import with_line_ordinal
from paidup.workspace import Workspace

INVOICE_TYPE = "RF"


def _clients(df: DataFrame) -> DataFrame:
    """Rows with a client and a document, and both names of the client."""
    rows = df.filter(F.col("client").isNotNull() & F.col("document").isNotNull())
    client = strip(F.col("client").cast("string"))
    return rows.withColumn("client", client).withColumn("client_norm", F.upper("client"))


def erp_items(raw: DataFrame, cutoff: dt.date | str | None = None) -> DataFrame:
    """Invoices (type RF) with a positive balance, from the header-named export and ``item_ord``."""
    rows = raw.select("item_ord", *[F.col(f"`{old}`").alias(new) for old, new in ERP_FILE_COLUMNS.items()])
    rows = rows.filter(F.col("doc_type") == INVOICE_TYPE).withColumn("open_amount", parse_money(F.col("open_amount")))
    rows = _clients(rows.filter(F.col("open_amount") > 0)).select(
        "item_ord",
        "client",
        "client_norm",
        F.col("document").cast("string").alias("document"),
        day_first_date(F.col("posting_date")).alias("posting_date"),
        day_first_date(F.col("due_date")).alias("due_date"),
        F.col("open_amount").alias("original_amount"),
        "open_amount",
    )
    return with_aging(rows, cutoff).select(*OPEN_ITEMS.fieldNames())


def weekly_items(raw: DataFrame, cutoff: dt.date | str | None = None, skip_rows: int = 3) -> DataFrame:
    """Invoices with a positive balance from a positional sheet of seven or eight columns.

    ``raw`` has ``item_ord`` first, then the sheet's columns; the first ``skip_rows`` rows are titles.
    """
    data = [c for c in raw.columns if c != "item_ord"]
    if len(data) < 7:
        raise ValueError(f"the weekly sheet has {len(data)} columns, expected 7 or 8")
    names = WEEKLY_COLUMNS[: min(len(data), 8)]
    rows = raw.filter(F.col("item_ord") >= skip_rows).select(
        "item_ord", *[F.col(f"`{old}`").alias(new) for old, new in zip(data, names)]
    )
    rows = rows.withColumn("open_amount", F.coalesce(parse_money(F.col("open_amount")), F.lit(0).cast(MONEY)))
    rows = _clients(rows.filter(F.col("open_amount") > 0)).select(
        "item_ord",
        "client",
        "client_norm",
        trailing_zero_dropped(F.col("document").cast("string")).alias("document"),
        day_first_date(F.col("posting_date")).alias("posting_date"),
        day_first_date(F.col("due_date")).alias("due_date"),
        parse_money(F.col("original_amount")).alias("original_amount"),
        "open_amount",
    )
    return with_aging(rows, cutoff).select(*OPEN_ITEMS.fieldNames())


def is_erp_export(columns: list[str]) -> bool:
    return "Tipo" in columns


def read_receivables(
    spark: SparkSession,
    path: str,
    cutoff: dt.date | str | None = None,
    skip_rows: int = 3,
    file_format: str = "csv",
    ws: Workspace | None = None,
) -> DataFrame:
    """Open items from a CSV or Parquet file of either layout, recognised by its header."""
    ws = ws or Workspace(spark)
    if file_format == "parquet":
        table = spark.read.parquet(path)
        numbered = with_line_ordinal(table, "item_ord", ws)
        return erp_items(numbered, cutoff) if is_erp_export(table.columns) else weekly_items(numbered, cutoff, skip_rows)
    named = spark.read.csv(path, header=True, encoding="UTF-8")
    if is_erp_export(named.columns):
        return erp_items(with_line_ordinal(named, "item_ord", ws), cutoff)
    positional = spark.read.csv(path, header=False, encoding="UTF-8")
    return weekly_items(with_line_ordinal(positional, "item_ord", ws), cutoff, skip_rows)
