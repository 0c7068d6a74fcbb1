"""Exceptions as a worklist: context, candidate invoices and the decisions a person may take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paidup.functions.dates import iso_text
from paidup.functions.money import currency_text
from paidup.functions.text import labelled, normal
from paidup.operators.decisions import active_decisions
from paidup.skew import lookup


def last_decision_dates(decisions: DataFrame) -> DataFrame:
    """When each fingerprint was last decided on, by time, reversals included."""
    return decisions.groupBy("fingerprint").agg(
        F.max(F.struct("decided_at", "decision_ord"))["decided_at"].alias("last_decided_at")
    )


def exceptions_worklist(exceptions: DataFrame, decisions: DataFrame, hot_fingerprints=()) -> DataFrame:
    """Exceptions with the day of an earlier decision, shown where the origin is manual."""
    dates = last_decision_dates(decisions)
    manual = F.col("origin").startswith("Manual")
    return lookup(exceptions, dates, ["fingerprint"], "left", hot_fingerprints, ["payment_id"]).select(
        *exceptions.columns, F.when(manual, iso_text(F.col("last_decided_at"))).alias("decided_on")
    )


def with_origin(exceptions: DataFrame, origins: Sequence[str] | None = None) -> DataFrame:
    return exceptions if origins is None else exceptions.filter(F.col("origin").isin(list(origins)))


def invoice_label(document: Column, open_amount: Column, due_date: Column) -> Column:
    """``doc  ·  $balance  ·  vence YYYY-MM-DD``."""
    return F.concat_ws(
        "  ·  ", document, currency_text(open_amount), F.concat(F.lit("vence "), F.coalesce(iso_text(due_date), F.lit("")))
    )


def document_labels(base: DataFrame) -> DataFrame:
    """Label of the first invoice with each document number."""
    first = F.min(F.struct("item_ord", "open_amount", "due_date"))
    return (
        base.groupBy("document")
        .agg(first.alias("first"))
        .select(
            "document",
            invoice_label(F.col("document"), F.col("first.open_amount"), F.col("first.due_date")).alias("label"),
        )
    )


def candidate_labels(candidates: DataFrame, base: DataFrame, hot_documents=()) -> DataFrame:
    """Candidates with their label; the bare number where the invoice is not in the table."""
    labelled_ = lookup(candidates, document_labels(base), ["document"], "left", hot_documents, ["pos"])
    return labelled_.withColumn("label", F.coalesce("label", "document"))


def _fixed_options(exceptions: DataFrame, state: str, actions: Sequence[str]) -> DataFrame:
    """Options without an invoice. Only unidentified payments keep their client here; the whole
    text of an unknown payer is proposed as the alias."""
    client = F.col("client") if state == "NO_IDENTIFICADO" else F.lit(None).cast("string")
    rows = exceptions.filter(F.col("match_state") == state)
    return rows.withColumn("action", F.explode(F.array(*[F.lit(a) for a in actions]))).select(
        *_EXCEPTION,
        "action",
        F.lit(None).cast("string").alias("document"),
        client.alias("client"),
        F.lit(None).cast("long").alias("cents"),
        F.when(F.col("action") == "AGREGAR_ALIAS", normal(F.col("description"))).alias("alias_source"),
    )


_EXCEPTION = ("payment_id", "fingerprint", "match_state")


def client_choices(base: DataFrame) -> DataFrame:
    """Open invoices a person may apply an unidentified payment to, by upper-case client."""
    return (
        base.filter(~F.col("is_paid"))
        .groupBy(F.upper("client_norm").alias("client_key"), "document")
        .agg(F.min(F.struct("item_ord", "open_amount", "due_date")).alias("first"))
        .select(
            "client_key",
            "document",
            invoice_label(F.col("document"), F.col("first.open_amount"), F.col("first.due_date")).alias("label"),
        )
    )


def decision_options(exceptions: DataFrame, base: DataFrame, sets: DataFrame) -> DataFrame:
    """The decisions a person may take, each written once.

    Options of a single payment carry its ``payment_id``. Those that all payments of a kind share do not: the invoices of
    a candidate set have its (client, cents), for the ambiguous payments that name the set; the open invoices of a client
    have its upper-case name, for the unidentified payments of that client. So payments are never paired with lists of invoices.
    """
    apply = F.lit("APLICAR_FACTURA").alias("action")
    nobody = [F.lit(None).cast("long").alias("payment_id"), F.lit(None).cast("string").alias("fingerprint")]
    no_cents, no_text = F.lit(None).cast("long").alias("cents"), F.lit(None).cast("string").alias("alias_source")
    ambiguous = exceptions.filter((F.col("match_state") == "AMBIGUO") & F.col("candidate_cents").isNull())
    to_listed = ambiguous.withColumn("document", F.explode(F.array_distinct("documents"))).select(
        *_EXCEPTION, apply, "document", "client", no_cents, no_text
    )
    to_set = sets.select("client_norm", "cents", "document").distinct().select(
        *nobody, F.lit("AMBIGUO").alias("match_state"), apply, "document", F.col("client_norm").alias("client"), "cents", no_text
    )
    asked = exceptions.filter(F.col("match_state") == "NO_IDENTIFICADO").select(F.upper("client").alias("client_key")).distinct()
    to_client = client_choices(base).join(asked, "client_key", "left_semi").select(
        *nobody, F.lit("NO_IDENTIFICADO").alias("match_state"), apply, "document", F.col("client_key").alias("client"), no_cents, no_text
    )
    return (
        to_listed.unionByName(to_set)
        .unionByName(to_client)
        .unionByName(_fixed_options(exceptions, "AMBIGUO", ("PENDIENTE", "NO_CORRESPONDE")))
        .unionByName(_fixed_options(exceptions, "NO_IDENTIFICADO", ("PAGO_PARCIAL", "PENDIENTE", "NO_CORRESPONDE")))
        .unionByName(
            _fixed_options(exceptions, "CLIENTE_DESCONOCIDO", ("AGREGAR_ALIAS", "CLIENTE_NUEVO", "NO_CORRESPONDE"))
        )
    )


def allowed(requests: DataFrame, exceptions: DataFrame, options: DataFrame) -> DataFrame:
    """The requests (payment_id, action, document or null) that are among the options of their payment."""
    key = ["__payment", "__client", "__cents", "__document", "match_state", "action"]
    pick = F.col("action") == "APLICAR_FACTURA"
    state = exceptions.select("payment_id", "match_state", "client", "candidate_cents")
    asked = requests.join(state, "payment_id")
    by_set = pick & F.col("candidate_cents").isNotNull()
    by_client = pick & (F.col("match_state") == "NO_IDENTIFICADO")
    asked = asked.withColumns(
        {
            "__payment": F.when(by_set | by_client, F.lit(-1)).otherwise(F.col("payment_id")),
            "__client": F.when(by_set, F.col("client")).when(by_client, F.upper("client")).otherwise(""),
            "__cents": F.when(by_set, F.col("candidate_cents")).otherwise(F.lit(-1)),
            "__document": F.when(pick, F.coalesce("document", F.lit(""))).otherwise(""),
        }
    )
    shared = F.col("payment_id").isNull()
    known = options.select(
        F.coalesce("payment_id", F.lit(-1)).alias("__payment"),
        F.when(shared, F.col("client")).otherwise("").alias("__client"),
        F.coalesce("cents", F.lit(-1)).alias("__cents"),
        "match_state",
        "action",
        F.coalesce("document", F.lit("")).alias("__document"),
    ).distinct()
    return asked.join(known, key, "left_semi").select(*requests.columns)


def active_decision_list(decisions: DataFrame, actions: Sequence[str] | None = None) -> DataFrame:
    """Active decisions, newest first, with their non-empty details as labelled text."""
    active = active_decisions(decisions)
    if actions is not None:
        active = active.filter(F.col("action").isin(list(actions)))
    details = F.array_compact(
        F.array(
            labelled("Pago", F.col("description")),
            F.when(F.col("amount").isNotNull(), F.concat(F.lit("**Monto:** "), currency_text(F.col("amount")))),
            labelled("Cliente", F.col("assigned_client")),
            labelled("Factura", F.col("assigned_document")),
            labelled("Alias origen", F.col("alias_source")),
            labelled("Comentario", F.col("comment")),
        )
    )
    return active.withColumn("details", F.array_join(details, " · ")).orderBy(
        F.desc("decided_at"), F.desc("decision_ord")
    )
