"""One reconciliation run, end to end."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paidup.config import RunSettings
from paidup.operators.candidates import candidate_sets
from paidup.operators.cascade import match_payments
from paidup.operators.classify import classify, customer_payments
from paidup.operators.consolidate import consolidate
from paidup.operators.ledger import accepted_decisions, aliases_from_decisions, history_rows, reversals, accepted_reversals
from paidup.skew import hot_keys
from paidup.sources import ledgers, runs
from paidup.sources.ordinals import dense_positions
from paidup.sources.outputs import write_table
from paidup.sources.receivables import read_receivables
from paidup.sources.statement import read_statement
from paidup.workspace import Workspace


@dataclass(frozen=True)
class RunPaths:
    """Where a run reads and writes. Ledgers and outputs are directories."""

    statement: str
    receivables: str
    aliases: str
    decisions: str
    history: str
    output: str


@dataclass(frozen=True)
class RunResult:
    movements: DataFrame
    open_items: DataFrame
    matches: DataFrame
    base: DataFrame
    exceptions: DataFrame
    candidate_sets: DataFrame
    new_history: DataFrame


def reconcile(
    movements: DataFrame,
    open_items: DataFrame,
    aliases: DataFrame,
    decisions: DataFrame,
    history: DataFrame,
    settings: RunSettings = RunSettings(),
    ws: Workspace | None = None,
    run_at: dt.datetime | None = None,
) -> RunResult:
    """The run on tables: nothing is read from or appended to the ledgers' storage."""
    ws = ws or Workspace(movements.sparkSession)
    classified = movements if "category" in movements.columns else classify(movements, settings.rules)
    if settings.dense_payment_ids:
        payments = customer_payments(classified)
        payments = dense_positions(payments, "movement_ord", "payment_pos", ws)
        payments = payments.withColumn("movement_ord", F.col("payment_pos")).drop("payment_pos")
    else:
        payments = classified
    matches = ws.stage(
        match_payments(payments, open_items, aliases, decisions, history, settings.match, ws), "matches"
    )
    (hot_documents,) = hot_keys(open_items, ["client_norm", "document"] if settings.join_on_client else ["document"])
    base, exceptions = consolidate(open_items, matches, settings.join_on_client, hot_documents)
    sets = candidate_sets(matches, open_items, settings.match)
    stamp = F.lit(run_at or dt.datetime.now().replace(microsecond=0)).cast("timestamp")
    fresh = history_rows(matches, stamp)
    return RunResult(classified, open_items, matches, base, exceptions, sets, fresh)


def run_reconciliation(
    spark: SparkSession,
    paths: RunPaths,
    settings: RunSettings = RunSettings(),
    receivables_format: str = "csv",
    run_at: dt.datetime | None = None,
) -> RunResult | None:
    """Read the files, match, write the result tables, then append the history.

    Returns None when no movement is left after the date filter. After a failure the call is repeated: a run that
    had promised rows to the history is finished first, and if it is this one (same movements, receivables
    and settings) its tables are returned. So no payment is appended twice and none is lost.
    """
    ws = Workspace(spark)
    movements = ws.stage(
        read_statement(spark, paths.statement, settings.date_from, settings.date_to, ws), "movements"
    )
    if movements.isEmpty():
        finish_runs(spark, paths)
        return None
    items = ws.stage(
        read_receivables(spark, paths.receivables, settings.cutoff, settings.skip_rows, receivables_format, ws),
        "open-items",
    )
    inputs = f"{runs.content_of(movements)}|{runs.content_of(items)}|{settings!r}"
    finished = finish_runs(spark, paths)
    if finished and finished[-1].inputs == inputs:
        tables = {name: spark.read.parquet(f"{paths.output}/{name}") for name in _OUTPUTS}
        fresh = spark.read.parquet(runs.pending_path(paths.output, finished[-1].run_id)).drop("request_ord")
        return RunResult(classify(movements, settings.rules), items, *tables.values(), fresh)
    days = movements.agg(F.min("value_date").alias("first"), F.max("value_date").alias("last")).first()
    result = reconcile(
        movements,
        items,
        ledgers.read_aliases(spark, paths.aliases),
        ledgers.read_decisions(spark, paths.decisions),
        ledgers.read_history(spark, paths.history, days["first"], days["last"]),
        settings,
        ws,
        run_at,
    )
    run = runs.PreparedRun(uuid.uuid4().hex, inputs)
    for name in _OUTPUTS:
        write_table(getattr(result, "base" if name == "consolidated" else name), f"{paths.output}/{name}")
    stamp = F.lit(run_at or dt.datetime.now().replace(microsecond=0)).cast("timestamp")
    write_table(history_rows(result.matches, stamp, "payment_id"), runs.pending_path(paths.output, run.run_id))
    runs.log_step(spark, paths.output, run, runs.PREPARED)
    finish_runs(spark, paths)
    fresh = spark.read.parquet(runs.pending_path(paths.output, run.run_id)).drop("request_ord")
    return RunResult(result.movements, items, result.matches, result.base, result.exceptions, result.candidate_sets, fresh)


# In the order of RunResult.
_OUTPUTS = ("matches", "consolidated", "exceptions", "candidate_sets")


def finish_runs(spark: SparkSession, paths: RunPaths) -> list[runs.PreparedRun]:
    """Append what runs have promised to the history and not yet wholly written; returns these runs."""
    unfinished = runs.prepared_runs(spark, paths.output)
    for run in unfinished:
        pending = spark.read.parquet(runs.pending_path(paths.output, run.run_id))
        ledgers.append_history(pending, paths.history, run.run_id)
        runs.log_step(spark, paths.output, run, runs.DONE)
    return unfinished


def record_decisions(
    requests: DataFrame, decisions_path: str, aliases_path: str, request_id: str | None = None
) -> None:
    """Append the acceptable decisions, and the aliases they teach, in the order of the requests.

    The order is ``request_ord``; without that column it is the order in which the requests stand,
    taken before anything is written. With a ``request_id`` (and ``request_ord``, different in all rows) the call can
    be repeated after a failure: neither a decision nor an alias is written twice, and none is left out.
    """
    ws = Workspace(requests.sparkSession)
    if "request_ord" not in requests.columns:
        if request_id is not None:
            raise ValueError("a repeatable request needs request_ord")
        requests = requests.withColumn("request_ord", F.monotonically_increasing_id())
    rows = ws.stage(accepted_decisions(requests, F.current_timestamp()), "decisions")
    ledgers.append_decisions(rows, decisions_path, request_id)
    ledgers.add_aliases(aliases_from_decisions(rows), aliases_path, request_id)


def revert_decisions(requests: DataFrame, decisions_path: str, history_path: str | None = None) -> DataFrame:
    """Append the acceptable reversals; returns every request with its outcome."""
    spark = requests.sparkSession
    history = ledgers.read_history(spark, history_path) if history_path else None
    outcome = reversals(ledgers.read_decisions(spark, decisions_path), requests, F.current_timestamp(), history)
    outcome = Workspace(spark).stage(outcome, "reversals")
    ledgers.append_decisions(accepted_reversals(outcome), decisions_path)
    return outcome
