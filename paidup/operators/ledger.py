"""Rows to append to the ledgers: decisions, reversals, aliases, processed payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paidup.config import ACTIVE, DECISION_ACTIONS, REVERTED
from paidup.functions.text import blank_to_null, normal
from paidup.operators.cascade import processed_fingerprints
from paidup.operators.consolidate import associated
from paidup.operators.decisions import last_decisions
from paidup.schemas import DECISIONS, HISTORY
from paidup.skew import lookup


def shaped(df: DataFrame, schema) -> DataFrame:
    """The columns of a ledger schema; missing ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def decision_problem() -> Column:
    """Why a decision cannot be recorded, null when it can."""
    action = normal(F.col("action"))
    return F.when(action == "REVERTIR", "reversals are requested on their own").when(
        (action == "AGREGAR_ALIAS") & blank_to_null(F.col("assigned_client")).isNull(), "alias without client"
    ).when(action.isNull() | ~action.isin(*DECISION_ACTIONS), "unknown action")


def accepted_decisions(requests: DataFrame, decided_at: Column) -> DataFrame:
    """The requests that can be recorded, as decision rows of this moment."""
    schema = DECISIONS
    if "request_ord" in requests.columns:
        schema = T.StructType([*DECISIONS.fields, T.StructField("request_ord", T.LongType(), True)])
    rows = shaped(requests, schema).withColumn("decided_at", decided_at)
    if "decision_state" not in requests.columns:
        rows = rows.withColumn("decision_state", F.lit(ACTIVE))
    return rows.filter(decision_problem().isNull()).withColumn("user", F.coalesce("user", F.lit("analista")))


def rejected_decisions(requests: DataFrame) -> DataFrame:
    return requests.withColumn("problem", decision_problem()).filter(F.col("problem").isNotNull())


def aliases_from_decisions(decisions: DataFrame) -> DataFrame:
    """Aliases that the accepted decisions teach."""
    return decisions.filter(
        (normal(F.col("action")) == "AGREGAR_ALIAS") & blank_to_null(F.col("alias_source")).isNotNull()
    ).select(
        F.col("alias_source").alias("alias"),
        F.col("assigned_client").alias("real_client"),
        F.concat(F.lit("Agregado desde dashboard — "), F.coalesce("description", F.lit(""))).alias("notes"),
        *([F.col("request_ord").alias("alias_ord")] if "request_ord" in decisions.columns else []),
    )


def new_aliases(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Normalised aliases that the catalogue lacks; the first request of an alias is kept, with its order."""
    order = F.col("alias_ord") if "alias_ord" in requested.columns else F.monotonically_increasing_id()
    wanted = (
        requested.withColumn("__ord", order)
        .select(normal(F.col("alias")).alias("alias"), normal(F.col("real_client")).alias("real_client"), "notes", "__ord")
        .groupBy("alias")
        .agg(F.min_by(F.struct("real_client", "notes"), "__ord").alias("first"), F.min("__ord").alias("request_ord"))
        .select("alias", "first.*", "request_ord")
    )
    known = existing.select(F.upper("alias").alias("alias")).distinct()
    return wanted.join(known, "alias", "left_anti")


def reversals(
    decisions: DataFrame, requests: DataFrame, decided_at: Column, history: DataFrame | None = None
) -> DataFrame:
    """Each requested fingerprint with the outcome of its reversal.

    ``accepted`` is true when the last decision is active and did not add an alias; such rows carry
    the reversal to append. ``reopens`` is false when the payment is in the history, because the
    history is consulted before decisions.
    """
    last = last_decisions(decisions).withColumn("last_action", normal(F.col("action")))
    state = F.upper(F.coalesce("decision_state", F.lit(ACTIVE)))
    ok = F.col("last_action").isNotNull() & (state == ACTIVE) & (F.col("last_action") != "AGREGAR_ALIAS")
    reason = F.col("comment") if "comment" in requests.columns else F.lit("")
    by = F.col("user") if "user" in requests.columns else F.lit("analista")
    at = F.col("request_ord") if "request_ord" in requests.columns else F.monotonically_increasing_id()
    asked = (
        requests.withColumn("__at", at)
        .groupBy("fingerprint")
        .agg(F.min(F.struct("__at", reason.alias("reason"), by.alias("requested_by"))).alias("request"))
        .select("fingerprint", "request.*")
        .drop("__at")
    )
    rows = asked.join(last, "fingerprint", "left").withColumn("accepted", F.coalesce(ok, F.lit(False)))
    default = F.concat(F.lit("Reversión de decisión previa ("), F.col("last_action"), F.lit(")."))
    rows = rows.select(
        decided_at.alias("decided_at"),
        "fingerprint",
        F.coalesce("origin_payment_id", F.lit(-1)).alias("origin_payment_id"),
        F.coalesce("amount", F.lit(0)).cast("decimal(18,2)").alias("amount"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit("REVERTIR").alias("action"),
        F.coalesce(blank_to_null(F.col("reason")), default).alias("comment"),
        F.col("requested_by").alias("user"),
        F.lit(REVERTED).alias("decision_state"),
        "last_action",
        "accepted",
    )
    if history is None:
        return rows.withColumn("reopens", F.col("accepted"))
    seen = processed_fingerprints(history).withColumn("seen", F.lit(True))
    return rows.join(seen, "fingerprint", "left").withColumn(
        "reopens", F.col("accepted") & F.col("seen").isNull()
    ).drop("seen")


def accepted_reversals(outcome: DataFrame) -> DataFrame:
    return shaped(outcome.filter("accepted"), DECISIONS)


def new_history(matches: DataFrame, history: DataFrame, run_at: Column, hot=()) -> DataFrame:
    """Associated payments that the history lacks. Equal payments of one run are all kept."""
    fresh = lookup(
        associated(matches), processed_fingerprints(history), ["fingerprint"], "left_anti", hot, ["payment_id"]
    )
    return history_rows(fresh, run_at)


def history_rows(matches: DataFrame, run_at: Column, order: str | None = None) -> DataFrame:
    """Associated payments as rows of the history; ``order`` is a column that becomes their ``request_ord``.

    The associations of a run are new to the history that the run was matched against: what it holds is
    ``YA_PROCESADO`` there, so the run needs no second look at it.
    """
    schema = HISTORY if order is None else T.StructType([*HISTORY.fields, T.StructField("request_ord", T.LongType())])
    rows = associated(matches)
    if order is not None:
        rows = rows.withColumn("request_ord", F.col(order))
    return shaped(
        rows.withColumn("run_at", run_at)
        .withColumn("payment_date", F.col("value_date"))
        .withColumn("initial_state", F.col("match_state")),
        schema,
    )


def history_counters(matches: DataFrame, history: DataFrame, hot=()) -> DataFrame:
    """One row: associated payments new to the history, and those it already had."""
    seen = processed_fingerprints(history).withColumn("seen", F.lit(True))
    rows = lookup(associated(matches), seen, ["fingerprint"], "left", hot, ["payment_id"])
    return rows.agg(
        F.count_if(F.col("seen").isNull()).alias("new_payments"), F.count_if("seen").alias("already_there")
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    """One row: all decision rows and active decisions."""
    per_payment = decisions.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("decision_state", "decision_ord").alias("decision_state")
    )
    active = F.upper(F.coalesce("decision_state", F.lit(ACTIVE))) == ACTIVE
    return per_payment.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("decisions"), F.count_if(active).alias("active_decisions")
    )
