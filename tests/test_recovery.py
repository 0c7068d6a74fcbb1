"""Runs and requests that break at any step and are repeated; the history by months."""

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from paidup.config import RunSettings
from paidup.operators.ledger import history_rows
from paidup.plans import reconcile as plan
from paidup.plans.reconcile import record_decisions, run_reconciliation
from paidup.sources import ledgers, outputs, runs
from tests import helpers as h
from tests.test_runs import MATCHES, paths  # noqa: F401

SETTINGS = RunSettings(cutoff=h.CUTOFF, skip_rows=2)


class Broken(Exception):
    pass


def breaks(monkeypatch, module, name, at=1):
    """The ``at``-th call of a function raises, the others work."""
    real, calls = getattr(module, name), []

    def sometimes(*args, **kwargs):
        calls.append(name)
        if len(calls) == at:
            raise Broken(name)
        return real(*args, **kwargs)

    monkeypatch.setattr(module, name, sometimes)


STEPS = [
    (plan, "write_table", 2),  # between two outputs
    (plan, "write_table", 5),  # outputs written, nothing promised
    (runs, "log_step", 1),  # pending rows written, not promised
    (ledgers, "append_history", 1),  # promised, nothing appended
    (runs, "log_step", 2),  # all appended, not logged
]


@pytest.mark.parametrize("module,name,at", STEPS, ids=[f"{n}-{a}" for _, n, a in STEPS])
def test_a_broken_run_is_repeated(spark, paths, monkeypatch, module, name, at):  # noqa: F811
    with monkeypatch.context() as patch:
        breaks(patch, module, name, at)
        with pytest.raises(Broken):
            run_reconciliation(spark, paths, SETTINGS)
    result = run_reconciliation(spark, paths, SETTINGS)
    rows = result.matches.orderBy("payment_id").collect()
    assert [(r.fingerprint, r.match_state, r.match_method) for r in rows] == [m[:3] for m in MATCHES]
    assert result.base.filter("is_paid").count() == 5 and result.exceptions.count() == 3
    assert outputs.read_table(spark, f"{paths.output}/consolidated", outputs.CONSOLIDATED).filter("is_paid").count() == 5
    assert result.new_history.count() == 3 and result.movements.count() == 14
    seen = [r.fingerprint for r in ledgers.read_history(spark, paths.history).collect()]
    assert sorted(seen) == sorted(m[0] for m in MATCHES[:3])


def test_an_append_that_wrote_some_rows_is_completed(spark, paths, monkeypatch):  # noqa: F811
    real = ledgers.append_history

    def half(rows, path, append_id=None):
        real(rows.orderBy("request_ord").limit(1), path, append_id)
        raise Broken("after one row")

    with monkeypatch.context() as patch:
        patch.setattr(ledgers, "append_history", half)
        with pytest.raises(Broken):
            run_reconciliation(spark, paths, SETTINGS)
    assert ledgers.read_history(spark, paths.history).count() == 1
    other = RunSettings(cutoff=h.CUTOFF, skip_rows=2, date_from="2026-05-01")
    assert run_reconciliation(spark, paths, other) is None  # another run finishes it as well
    seen = [r.fingerprint for r in ledgers.read_history(spark, paths.history).collect()]
    assert sorted(seen) == sorted(m[0] for m in MATCHES[:3])
    assert runs.prepared_runs(spark, paths.output) == []


@pytest.mark.parametrize("name", ["append_decisions", "add_aliases"])
def test_a_broken_request_is_repeated(spark, tmp_path, monkeypatch, name):
    requests = spark.createDataFrame(
        [("a" * 16, "AGREGAR_ALIAS", "C", "uno", 1), ("b" * 16, "PENDIENTE", None, None, 2)],
        "fingerprint string, action string, assigned_client string, alias_source string, request_ord long",
    )
    at = str(tmp_path / "decisions"), str(tmp_path / "aliases")
    with monkeypatch.context() as patch:
        breaks(patch, ledgers, name)
        with pytest.raises(Broken):
            record_decisions(requests, *at, "r1")
    record_decisions(requests, *at, "r1")
    record_decisions(requests, *at, "r1")
    assert ledgers.read_decisions(spark, at[0]).count() == 2 and ledgers.read_aliases(spark, at[1]).count() == 1
    record_decisions(requests, *at, "r2")
    assert ledgers.read_decisions(spark, at[0]).count() == 4
    with pytest.raises(ValueError):
        record_decisions(requests.drop("request_ord"), *at, "r3")


def history_of(spark, days):
    rows = [(i, d, f"PAGO {i}") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "payment_id long, value_date date, description string")
    df = df.select(
        "*",
        F.lit(10).cast("decimal(18,2)").alias("amount"),
        F.lit("ASOCIADO").alias("match_state"),
        F.lit("exacto").alias("match_method"),
        F.array(F.lit("F")).alias("documents"),
    )
    from paidup.functions.fingerprint import payment_fingerprint

    df = df.withColumn("fingerprint", payment_fingerprint(F.col("description"), F.col("amount"), F.col("value_date")))
    return history_rows(df, F.lit("2026-04-16").cast("timestamp"))


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_only_the_months_of_the_payments_are_read(spark, tmp_path):
    path = str(tmp_path / "history")
    days = [dt.date(2026, 1, 31), dt.date(2026, 3, 1), dt.date(2026, 3, 31), dt.date(2026, 4, 1), None]
    ledgers.append_history(history_of(spark, days), path)
    # a row whose day was written otherwise than its fingerprint has it: it may belong to any month
    odd = history_of(spark, [dt.date(2026, 3, 5)]).withColumn("payment_date", F.lit("2026-01-05").cast("date"))
    ledgers.append_history(odd, path)
    rows = ledgers.read_history(spark, path, dt.date(2026, 3, 2), dt.date(2026, 3, 9))
    found = {r.payment_date for r in rows.collect()}
    assert found == {dt.date(2026, 3, 1), dt.date(2026, 3, 31), dt.date(2026, 1, 5), None}
    assert "PartitionFilters: [" in plan_of(rows) and "fingerprint_month" in plan_of(rows)
    assert ledgers.read_history(spark, path).count() == 6


def test_a_flat_history_is_refused(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = history_of(spark, [dt.date(2026, 3, 1)])
    rows.write.parquet(path)
    with pytest.raises(ValueError, match="new path"):
        ledgers.append_history(rows, path)
    assert ledgers.read_history(spark, path).count() == 1


def test_the_run_joins_history_without_an_outer_join(spark):
    from paidup.operators import cascade
    from paidup.operators.classify import classify
    from paidup.operators.cascade import _settle_from_ledgers

    payments = cascade.payments_of(classify(h.movements(spark, [(1, "PAGO")])))
    items = h.items(spark, [("C", "F", 1, 1)])
    text = plan_of(_settle_from_ledgers(payments, h.decisions(spark), h.history(spark), items, [], []))
    assert "FullOuter" not in text
