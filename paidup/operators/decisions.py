"""Prior human decisions: which one counts, whether it still holds, what it means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.config import ACTIVE, NOTES
from paidup.functions.text import blank_to_null, normal
from paidup.skew import lookup


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each fingerprint in append order, whatever its state."""
    columns = decisions.columns
    return (
        decisions.groupBy("fingerprint")
        .agg(F.max_by(F.struct(*columns), "decision_ord").alias("last"))
        .select("last.*")
    )


def last_decision_of(decisions: DataFrame, fingerprint: str) -> DataFrame:
    """The last decision of one fingerprint, in any state."""
    return last_decisions(decisions.filter(F.col("fingerprint") == fingerprint))


def is_active():
    return F.upper(F.coalesce("decision_state", F.lit(ACTIVE))) == ACTIVE


def active_decisions(decisions: DataFrame) -> DataFrame:
    """Fingerprints whose last decision is active: a reversal hides everything before it."""
    return last_decisions(decisions).filter(is_active())


def _applied(active: DataFrame) -> DataFrame:
    return active.filter(normal(F.col("action")) == "APLICAR_FACTURA")


def claimed_documents(active: DataFrame) -> DataFrame:
    """Documents claimed by more than one active decision, with the number of claims."""
    return (
        _applied(active)
        .groupBy(blank_to_null(F.col("assigned_document")).alias("document"))
        .agg(F.count(F.lit(1)).alias("claims"))
        .filter(F.col("document").isNotNull() & (F.col("claims") > 1))
    )


def documents_still_open(active: DataFrame, open_items: DataFrame, hot_documents=()) -> DataFrame:
    """The assigned documents that are among the open receivables."""
    wanted = (
        _applied(active)
        .select(blank_to_null(F.col("assigned_document")).alias("document"))
        .filter(F.col("document").isNotNull())
        .distinct()
    )
    numbers = open_items.select(blank_to_null(F.col("document")).alias("document"), "item_ord")
    return lookup(numbers, wanted, ["document"], "left_semi", hot_documents, ["item_ord"]).select("document").distinct()


def decision_validity(active: DataFrame, open_items: DataFrame) -> DataFrame:
    """Each decision that applies an invoice, with ``still_open``."""
    still_open = documents_still_open(active, open_items).withColumn("still_open", F.lit(True))
    return (
        _applied(active)
        .withColumn("document", blank_to_null(F.col("assigned_document")))
        .join(still_open, "document", "left")
        .select("fingerprint", "document", F.coalesce("still_open", F.lit(False)).alias("still_open"))
    )


def missing_documents(active: DataFrame, open_items: DataFrame) -> DataFrame:
    """Assigned documents no longer open, sorted."""
    gone = decision_validity(active, open_items).filter(~F.col("still_open") & F.col("document").isNotNull())
    return gone.select("document").distinct().orderBy("document")


def decision_outcomes(decisions: DataFrame, open_items: DataFrame, hot_documents=()) -> DataFrame:
    """fingerprint -> the match result that its last active decision dictates.

    Decisions that leave the payment to the cascade (alias added, invoice no longer open, invoice
    missing, unknown action) are not in the output. Validity is tested before conflict.
    """
    active = active_decisions(decisions)
    still_open = documents_still_open(active, open_items, hot_documents).withColumn("still_open", F.lit(True))
    claimed = claimed_documents(active)
    base = (
        active.withColumn("action", normal(F.col("action")))
        .withColumn("document", blank_to_null(F.col("assigned_document")))
        .join(still_open, "document", "left")
        .join(claimed, "document", "left")
    )
    applies = (F.col("action") == "APLICAR_FACTURA") & F.col("still_open")
    method = (
        F.when(applies & (F.col("claims") > 1), "manual_conflicto")
        .when(applies, "manual_analista")
        .when(F.col("action") == "PAGO_PARCIAL", "manual_parcial")
        .when(F.col("action") == "PENDIENTE", "manual_pendiente")
        .when(F.col("action") == "NO_CORRESPONDE", "manual_no_aplica")
        .when(F.col("action") == "CLIENTE_NUEVO", "manual_cliente_nuevo")
    )
    state = (
        F.when(F.col("match_method") == "manual_conflicto", "AMBIGUO")
        .when(F.col("match_method") == "manual_analista", "ASOCIADO")
        .when(F.col("match_method") == "manual_pendiente", "PENDIENTE_ANALISTA")
        .when(F.col("match_method") == "manual_no_aplica", "NO_APLICA")
        .otherwise("NO_IDENTIFICADO")
    )
    note = F.when(
        F.col("match_method") == "manual_conflicto",
        F.replace(F.lit(NOTES["manual_conflicto"]), F.lit("{document}"), F.col("document")),
    ).when(
        F.col("match_method") == "manual_analista",
        F.replace(
            F.lit(NOTES["manual_analista"]),
            F.lit("{decided_at}"),
            F.coalesce(F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")),
        ),
    )
    for name in ("manual_parcial", "manual_pendiente", "manual_no_aplica", "manual_cliente_nuevo"):
        note = note.when(F.col("match_method") == name, NOTES[name])
    with_document = F.col("match_method").isin("manual_conflicto", "manual_analista")
    return (
        base.withColumn("match_method", method)
        .filter(F.col("match_method").isNotNull())
        .select(
            "fingerprint",
            state.alias("match_state"),
            "match_method",
            F.when(F.col("match_method") != "manual_no_aplica", blank_to_null(F.col("assigned_client"))).alias("client"),
            F.when(with_document, F.array("document")).otherwise(F.array().cast("array<string>")).alias("documents"),
            note.alias("note"),
        )
    )
