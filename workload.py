"""Receivables tables derived from the star-schema test tables.

The given tables hold no bank statement, so one is derived from orders and customers: open invoices,
the movements that pay them (in twelve patterns), aliases, a history and decisions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paidup.functions.fingerprint import payment_fingerprint
from paidup.functions.text import normal
from paidup.operators.aging import with_aging
from paidup.operators.classify import flow_of
from paidup.schemas import MONEY

CUTOFF = dt.date(2001, 8, 1)


_SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders_of_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"),
        F.col("c_custkey").alias("ck"),
        F.col("c_name").alias("client"),
        normal(F.col("c_name")).alias("client_norm"),
        F.col("o_orderstatus").alias("status"),
        ((F.lit(1) + F.floor(F.col("o_totalprice") / 1000)) * 1000).cast(MONEY).alias("open_amount"),
    )


def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.date_sub(F.lit(CUTOFF), (F.col("k") % 170 - 20).cast("int"))
    items = (
        _orders_of_clients(spark, sf_dir)
        .filter(F.col("status") != "F")
        .select(
            F.col("k").alias("item_ord"),
            "client",
            "client_norm",
            F.concat(F.lit("FV-"), F.col("k").cast("string")).alias("document"),
            F.date_sub(due, 30).alias("posting_date"),
            due.alias("due_date"),
            F.col("open_amount").alias("original_amount"),
            "open_amount",
        )
    )
    return with_aging(items, CUTOFF)


def _credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment per open invoice, in twelve patterns by k % 12."""
    by_client = Window.partitionBy("ck").orderBy("k")
    zero = F.lit(0).cast(MONEY)
    rows = (
        _orders_of_clients(spark, sf_dir)
        .filter(F.col("status") != "F")
        .select(
            "k",
            "ck",
            "client_norm",
            F.col("open_amount").alias("amt"),
            *[F.coalesce(F.lead("open_amount", i).over(by_client), zero).alias(f"a{i}") for i in (1, 2, 3)],
        )
    )
    k, kind = F.col("k").cast("string"), F.col("k") % 12
    cn, amt = F.col("client_norm"), F.col("amt")
    text = (
        F.when(kind.isin(0, 4, 7, 8, 9), F.concat(F.lit("PAGO DE PROV "), cn))
        .when(kind == 1, F.concat(F.lit("PAGO INTERBANC "), cn))
        .when(kind == 2, F.concat(F.lit("PAGO DE PROV "), cn, F.lit(" REF FV-"), k))
        .when(kind == 3, F.concat(F.lit("PAGO DE PROV TERCERO "), k))
        .when(kind == 5, F.concat(F.lit("TRANSFER ALFA "), F.lpad(F.col("ck").cast("string"), 9, "0")))
        .when(kind == 6, F.concat(F.lit("ABONO GRUPO BETA "), k))
        .otherwise(F.concat(F.lit("CONSIGNACION "), k))
    )
    amount = (
        F.when(kind == 1, amt + F.col("a1"))
        .when(kind == 2, amt + 333)
        .when(kind == 4, amt + 500)
        .when(kind == 7, amt + 1)
        .when(kind == 8, amt + F.col("a1") + F.col("a2"))
        .when(kind == 9, amt + F.col("a1") + F.col("a2") + F.col("a3"))
        .otherwise(amt)
    )
    return rows.select("k", text.alias("description"), amount.cast(MONEY).alias("amount"))


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("PAGO A PROVEEDOR "), F.col("o_orderkey").cast("string")))
        .when(kind == 1, "ABONO INTERESES AHORROS")
        .when(kind == 2, "IMPTO GOBIERNO 4X1000")
        .when(kind == 3, "DEBITO POR ABONO CARTERA")
        .when(kind == 4, "PAGO EMPLEADO NOMINA")
        .otherwise("COMISION MANEJO")
    )
    amount = F.when(kind == 1, 5).when(kind == 5, 0).otherwise(-1000 - F.col("o_orderkey") % 1000)
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(F.col("o_orderkey").alias("k"), text.alias("description"), amount.cast(MONEY).alias("amount"))
    )


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _credits(spark, sf_dir).unionByName(_noise(spark, sf_dir))
    return rows.select(
        F.col("k").alias("movement_ord"),
        F.date_sub(F.lit(CUTOFF), (F.col("k") % 30).cast("int")).alias("value_date"),
        "amount",
        F.abs("amount").alias("amount_abs"),
        flow_of(F.col("amount")).alias("flow"),
        "description",
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (
        _orders_of_clients(spark, sf_dir)
        .filter((F.col("status") != "F") & (F.col("ck") % 2 == 0))
        .select("ck", "client_norm")
        .distinct()
        .select(
            F.concat(F.lit("TRANSFER ALFA "), F.lpad(F.col("ck").cast("string"), 9, "0")).alias("alias"),
            F.col("client_norm").alias("real_client"),
            F.lit("").alias("notes"),
            F.col("ck").alias("alias_ord"),
        )
    )
    beta = spark.createDataFrame(
        [("GRUPO BETA", "CLIENTE SIN CARTERA", "", 1 << 40)], "alias string, real_client string, notes string, alias_ord long"
    )
    return own.unionByName(beta)


def _deposits(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """The deposits without a payer name: k % 12 = 10 (decided) or 11 (processed before)."""
    return (
        _orders_of_clients(spark, sf_dir)
        .filter((F.col("status") != "F") & (F.col("k") % 12 == kind))
        .select(
            "k",
            "client_norm",
            F.col("open_amount").alias("amount"),
            F.concat(F.lit("CONSIGNACION "), F.col("k").cast("string")).alias("description"),
            F.date_sub(F.lit(CUTOFF), (F.col("k") % 30).cast("int")).alias("value_date"),
        )
        .withColumn("fingerprint", payment_fingerprint(F.col("description"), F.col("amount"), F.col("value_date")))
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _deposits(spark, sf_dir, 11)
        .filter(F.floor(F.col("k") / 12) % 2 == 0)
        .select(
            F.timestamp_add("DAY", -(F.floor(F.col("k") / 24) % 3).cast("int"), F.lit(CUTOFF).cast("timestamp")).alias("run_at"),
            "fingerprint",
            F.col("value_date").alias("payment_date"),
            "amount",
            "description",
            F.lit("ASOCIADO").alias("initial_state"),
            F.lit("exacto").alias("match_method"),
            F.array(F.concat(F.lit("FV-"), F.col("k").cast("string"))).alias("documents"),
        )
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    smallest = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") != "F")
        .agg(F.concat(F.lit("FV-"), F.min("o_orderkey").cast("string")).alias("smallest"))
        .withColumn("kind", F.lit(2).cast("long"))
    )
    kind = F.floor(F.col("k") / 12) % 8
    own = F.concat(F.lit("FV-"), F.col("k").cast("string"))
    rows = _deposits(spark, sf_dir, 10).withColumn("kind", kind).join(smallest, "kind", "left")
    action = (
        F.when(F.col("kind").isin(0, 1, 2, 7), "APLICAR_FACTURA")
        .when(F.col("kind") == 3, "PAGO_PARCIAL")
        .when(F.col("kind") == 4, "PENDIENTE")
        .when(F.col("kind") == 5, "NO_CORRESPONDE")
        .otherwise("CLIENTE_NUEVO")
    )
    document = (
        F.when(F.col("kind").isin(0, 7), own)
        .when(F.col("kind") == 1, F.concat(F.lit("FV-X"), F.col("k").cast("string")))
        .when(F.col("kind") == 2, F.col("smallest"))
    )
    base = [
        F.timestamp_add("MINUTE", (F.col("k") % 1000).cast("int"), F.lit(CUTOFF).cast("timestamp")).alias("decided_at"),
        "fingerprint",
        F.col("k").alias("origin_payment_id"),
        "amount",
        "description",
    ]
    first = rows.select(
        *base,
        action.alias("action"),
        document.alias("assigned_document"),
        F.col("client_norm").alias("assigned_client"),
        F.lit(None).cast("string").alias("alias_source"),
        F.lit("").alias("comment"),
        F.lit("analista").alias("user"),
        F.lit("ACTIVA").alias("decision_state"),
        (F.col("k") * 2).alias("decision_ord"),
    )
    reversal = rows.filter(F.col("kind") == 7).select(
        F.timestamp_add("DAY", F.lit(1), F.lit(CUTOFF).cast("timestamp")).alias("decided_at"),
        *base[1:],
        F.lit("REVERTIR").alias("action"),
        F.lit(None).cast("string").alias("assigned_document"),
        F.lit(None).cast("string").alias("assigned_client"),
        F.lit(None).cast("string").alias("alias_source"),
        F.lit("").alias("comment"),
        F.lit("analista").alias("user"),
        F.lit("REVERTIDA").alias("decision_state"),
        (F.col("k") * 2 + 1).alias("decision_ord"),
    )
    return first.unionByName(reversal)


def segment_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items of a few large clients (the market segments): amounts in steps of 100,000, so that hundreds of
    invoices are equal, and document numbers that several invoices share."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "F")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("o_orderkey")
    amount = ((F.lit(1) + F.floor(F.col("o_totalprice") / 100000)) * 100000).cast(MONEY)
    due = F.date_sub(F.lit(CUTOFF), (k % 170 - 20).cast("int"))
    items = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("item_ord"),
        F.initcap("c_mktsegment").alias("client"),
        F.upper("c_mktsegment").alias("client_norm"),
        F.concat(F.lit("FV-"), F.floor(k / 8).cast("string")).alias("document"),
        F.date_sub(due, 30).alias("posting_date"),
        due.alias("due_date"),
        amount.alias("original_amount"),
        amount.alias("open_amount"),
    )
    return with_aging(items, CUTOFF)


def segment_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment for every open item of the large clients: of its amount, of its amount but for the tolerance, or of
    another amount; the last two quote the number."""
    rows = segment_items(spark, sf_dir)
    k = F.col("item_ord")
    amount = F.when(k % 3 == 0, F.col("open_amount")).when(k % 3 == 1, F.col("open_amount") + 1).otherwise(F.col("open_amount") + 333)
    quote = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" REF "), F.col("document")))
    return rows.select(
        k.alias("movement_ord"),
        F.date_sub(F.lit(CUTOFF), (k % 30).cast("int")).alias("value_date"),
        amount.cast(MONEY).alias("amount"),
        F.concat(F.lit("PAGO DE PROV "), F.col("client_norm"), quote).alias("description"),
        F.lit("PAGO_CLIENTE").alias("category"),
    )


def clients_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients whose names share words: segment, nation and a suffix."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.upper(F.concat_ws(" ", "c_mktsegment", "n_name", F.lit("SAS"))).alias("client_norm"))
        .agg(F.min("c_custkey").alias("item_ord"))
    )


def texts_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two payment texts per order: one names the nation, one the segment of the customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    k = F.col("o_orderkey").cast("string")
    return rows.select(
        F.explode(
            F.array(
                F.concat(F.lit("PAGO "), F.col("n_name"), F.lit(" "), k),
                F.concat(F.lit("PAGO "), F.col("c_mktsegment"), F.lit(" "), k),
            )
        ).alias("description")
    )


def statement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movements as a bank would write them: text with blanks, some dates and amounts invalid."""
    rows = movements(spark, sf_dir)
    k = F.col("movement_ord")
    day = F.when(k % 50 == 49, "20261399").otherwise(F.date_format("value_date", "yyyyMMdd"))
    amount = F.when(k % 70 == 69, "n/a").otherwise(F.col("amount").cast("string"))
    code = F.when(k % 30 == 29, "").otherwise((k % 1000).cast("string"))
    return rows.select(
        "movement_ord",
        F.concat(F.lit(" "), day).alias("date_raw"),
        F.concat(F.lit("  "), amount, F.lit("\t")).alias("amount"),
        F.concat(F.lit(" "), code).alias("code"),
        F.concat(F.lit("  "), F.lower("description"), F.lit("\t ")).alias("description"),
    )


def sheet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open items as a weekly sheet: mixed date formats, document numbers stored as numbers,
    some rows without client, some without balance."""
    rows = _orders_of_clients(spark, sf_dir).filter(F.col("status") != "F")
    k = F.col("k")
    due = F.date_sub(F.lit(CUTOFF), (k % 170 - 20).cast("int"))
    due_text = (
        F.when(k % 40 == 39, "pendiente")
        .when(k % 3 == 0, F.date_format(due, "dd/MM/yyyy"))
        .when(k % 3 == 1, F.date_format(due, "yyyy-MM-dd"))
        .otherwise(F.date_format(due, "d/M/yyyy"))
    )
    number = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(F.concat(k.cast("string"), F.lit(".05")))
    return rows.select(
        k.alias("item_ord"),
        F.when(k % 25 != 24, F.concat(F.col("client"), F.lit("  "))).alias("client"),
        number.alias("document"),
        F.date_format(F.date_sub(due, 30), "dd/MM/yyyy").alias("posting_date"),
        due_text.alias("due_date"),
        F.col("open_amount").cast("string").alias("original_amount"),
        F.when(k % 35 == 34, "x").when(k % 35 == 33, "-5").otherwise(F.col("open_amount").cast("string")).alias("open_amount"),
        F.lit("0").alias("future_credit"),
    )


def erp_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open items as an ERP export with header names."""
    rows = sheet_fields(spark, sf_dir)
    return rows.select(
        "item_ord",
        F.when(F.col("item_ord") % 9 == 8, "NC").otherwise("RF").alias("Tipo"),
        F.col("client").alias("Nombre SN"),
        F.col("document").alias("Nº documento"),
        F.col("posting_date").alias("Fecha de contabilización"),
        F.col("due_date").alias("Fecha de vencimiento"),
        F.col("open_amount").alias("Saldo vencido"),
    )
