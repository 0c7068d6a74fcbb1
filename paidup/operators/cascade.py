"""The payment-to-invoice cascade.

history -> prior decision -> client -> exact amount -> sum of invoices -> quoted number. Each level
sees only the payments that no earlier level answered. No level uses invoices up, so payments are
independent of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.config import NOTES, MatchSettings
from paidup.functions.fingerprint import payment_fingerprint
from paidup.functions.money import cents
from paidup.operators.amounts import client_profiles, priced_items, resolve_amounts
from paidup.operators.classify import customer_payments
from paidup.operators.decisions import decision_outcomes
from paidup.operators.docref import quoted_documents
from paidup.operators.identify import identify
from paidup.schemas import MATCH_RESULT
from paidup.skew import hot_keys, lookup
from paidup.workspace import Workspace


def _none():
    return F.array().cast("array<string>")


def _shape(df: DataFrame) -> DataFrame:
    """Exactly the columns of a match result."""
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in MATCH_RESULT.fields],
    )


def payments_of(movements: DataFrame) -> DataFrame:
    """Customer payments with their identity: the movement ordinal is the payment id."""
    return customer_payments(movements).select(
        F.col("movement_ord").alias("payment_id"),
        "value_date",
        "amount",
        "description",
        payment_fingerprint(F.col("description"), F.col("amount"), F.col("value_date")).alias("fingerprint"),
    )


def processed_fingerprints(history: DataFrame) -> DataFrame:
    """Distinct fingerprints of the history."""
    return history.select("fingerprint").filter(F.col("fingerprint").isNotNull()).distinct()


def already_processed(payments: DataFrame, history: DataFrame, hot=()) -> DataFrame:
    """Payments of an earlier run."""
    return lookup(payments, processed_fingerprints(history), ["fingerprint"], "left_semi", hot, ["payment_id"])


def not_yet_processed(payments: DataFrame, history: DataFrame, hot=()) -> DataFrame:
    return lookup(payments, processed_fingerprints(history), ["fingerprint"], "left_anti", hot, ["payment_id"])


def _settle_from_ledgers(
    payments: DataFrame, decisions: DataFrame, history: DataFrame, items: DataFrame, hot, hot_numbers
) -> DataFrame:
    """Add the verdict of history (first) or of a prior decision; null verdict = still open."""
    seen = processed_fingerprints(history).withColumn("seen", F.lit(True))
    ruled = decision_outcomes(decisions, items, hot_numbers).select(
        "fingerprint", F.struct("match_state", "match_method", "client", "documents", "note").alias("ruling")
    )
    old = F.struct(
        F.lit("YA_PROCESADO").alias("match_state"),
        F.lit("historial").alias("match_method"),
        F.lit(None).cast("string").alias("client"),
        _none().alias("documents"),
        F.lit(NOTES["historial"]).alias("note"),
        F.lit("historial").alias("client_method"),
    )
    ruling = F.struct("ruling.*", F.lit("manual").alias("client_method"))
    met = lookup(payments, seen, ["fingerprint"], "left", hot, ["payment_id"])
    return lookup(met, ruled, ["fingerprint"], "left", hot, ["payment_id"]).select(
        *payments.columns, F.when(F.col("seen"), old).when(F.col("ruling").isNotNull(), ruling).alias("verdict")
    )


def _amount_verdicts(df: DataFrame) -> DataFrame:
    """State and documents from client identification and the amount levels."""
    exact, sums = F.col("n_exact"), F.col("n_sums")
    unknown = F.col("client").isNull()
    no_items = F.col("n_items").isNull()

    def counted(name: str, n):
        return F.replace(F.lit(NOTES[name]), F.lit("{n}"), n.cast("string"))

    return df.select(
        "payment_id",
        "value_date",
        "amount",
        "description",
        "fingerprint",
        "client",
        F.when(unknown, "CLIENTE_DESCONOCIDO")
        .when(no_items, "NO_IDENTIFICADO")
        .when((exact == 1) | (exact.isNull() & (sums == 1)), "ASOCIADO")
        .when((exact > 1) | (sums > 1), "AMBIGUO")
        .alias("match_state"),
        F.when(unknown | no_items, "ninguno")
        .when(exact == 1, "exacto")
        .when(exact > 1, "exacto_multiple")
        .when(sums == 1, "acumulado")
        .when(sums > 1, "acumulado_multiple")
        .alias("match_method"),
        F.coalesce("client_method", F.lit("ninguno")).alias("client_method"),
        F.coalesce("exact", F.when(exact.isNull(), F.col("first_sum")), _none()).alias("documents"),
        F.coalesce(exact, F.size("first_sum").cast("long"), F.lit(0)).alias("n_documents"),
        F.when(exact > 1, F.col("cents")).alias("candidate_cents"),
        F.when(unknown, NOTES["unknown_client"])
        .when(no_items, NOTES["no_open_items"])
        .when(exact > 1, counted("exacto_multiple", exact))
        .when(sums > 1, counted("acumulado_multiple", sums))
        .otherwise("")
        .alias("note"),
    )


def match_payments(
    movements: DataFrame,
    open_items: DataFrame,
    aliases: DataFrame,
    decisions: DataFrame,
    history: DataFrame,
    settings: MatchSettings = MatchSettings(),
    ws: Workspace | None = None,
) -> DataFrame:
    """One result row per customer payment, in the shape of ``schemas.MATCH_RESULT``.

    ``documents`` are the invoices paid, the first sum that fits, or the numbers quoted, each once. Where several
    invoices equal the amount, ``candidate_cents`` names their set (``candidates.candidate_sets``) and
    ``documents`` is empty; ``n_documents`` counts the invoices in every case.

    Wide intermediate results are written as stage tables, each read column-pruned by the next
    levels; every join of payments goes through a skew-safe lookup.
    """
    ws = ws or Workspace(movements.sparkSession)
    items = ws.stage(priced_items(open_items), "items")
    payments = ws.stage(payments_of(movements), "payments")
    hot_fingerprints, hot_texts = hot_keys(payments, ["fingerprint"], ["description"])
    (hot_numbers,) = hot_keys(items, ["document"])

    judged = ws.stage(_settle_from_ledgers(payments, decisions, history, items, hot_fingerprints, hot_numbers), "judged")
    settled = judged.filter(F.col("verdict").isNotNull()).select(
        "*", "verdict.*", F.size("verdict.documents").alias("n_documents"), F.lit(None).alias("candidate_cents")
    )
    still_open = judged.filter(F.col("verdict").isNull()).drop("verdict")
    named = identify(still_open, aliases, items, ws, hot_texts)
    named = ws.stage(
        named.withColumn("client_norm", F.col("client")).withColumn("cents", cents(F.col("amount"))), "named"
    )

    hot_named_clients, hot_amounts = hot_keys(named, ["client_norm"], ["client_norm", "cents"])
    profiles = client_profiles(items, settings)
    queries = named.filter(F.col("client").isNotNull()).select("client_norm", "cents").distinct()
    answers = resolve_amounts(queries, items, profiles, settings, hot_named_clients)
    answered = ws.stage(
        _amount_verdicts(lookup(named, answers, ["client_norm", "cents"], "left", hot_amounts, ["payment_id"])),
        "answered",
    )

    resolved = answered.filter(F.col("match_state").isNotNull())
    rest = answered.filter(F.col("match_state").isNull())
    quoted = quoted_documents(rest.withColumn("client_norm", F.col("client")), items, ws, hot_named_clients)
    is_quoted = F.col("n_quoted").isNotNull()
    rest = rest.join(quoted, "payment_id", "left").select(
        "payment_id",
        "value_date",
        "amount",
        "description",
        "fingerprint",
        "client",
        F.when(is_quoted, "ASOCIADO").otherwise("NO_IDENTIFICADO").alias("match_state"),
        F.when(is_quoted, "referencia").otherwise("ninguno").alias("match_method"),
        "client_method",
        F.coalesce("quoted", _none()).alias("documents"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_documents"),
        F.lit(None).alias("candidate_cents"),
        F.when(is_quoted, "").otherwise(NOTES["nothing_matches"]).alias("note"),
    )
    return _shape(settled).unionByName(_shape(resolved)).unionByName(_shape(rest))


def match_counters(matches: DataFrame) -> DataFrame:
    """One row: payments decided by a prior decision and payments skipped as already processed."""
    return matches.agg(
        F.count_if(F.col("client_method") == "manual").alias("decisions_applied"),
        F.count_if(F.col("match_state") == "YA_PROCESADO").alias("already_processed"),
    )
