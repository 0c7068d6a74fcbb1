"""Order of appended rows, quoted lists, clients as an analyst types them."""

import pytest
from pyspark.sql import functions as F

from paidup.operators.consolidate import consolidate_items
from paidup.operators.decisions import last_decisions
from paidup.plans.reconcile import record_decisions
from paidup.sources import ledgers
from paidup.sources.outputs import export_csv, import_csv


def test_last_request_of_a_batch_in_many_partitions_wins(spark, tmp_path):
    rows = [("FP1", "PENDIENTE", "first")] + [(f"X{i}", "PENDIENTE", "") for i in range(400)]
    rows.append(("FP1", "NO_CORRESPONDE", "second"))
    requests = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "fingerprint string, action string, comment string")
    record_decisions(requests, str(tmp_path / "d"), str(tmp_path / "a"))
    last = last_decisions(ledgers.read_decisions(spark, str(tmp_path / "d"))).filter("fingerprint = 'FP1'").first()
    assert (last.comment, last.action) == ("second", "NO_CORRESPONDE")


def test_aliases_keep_the_order_of_their_requests(spark, tmp_path):
    names = ["GRUPO ANDINO NORTE", "GRUPO ANDINO", "ANDINO NORTE", "NORTE", "ANDINO"]
    rows = [(f"F{i}", "AGREGAR_ALIAS", name, f"C{i}") for i, name in enumerate(names)]
    schema = "fingerprint string, action string, alias_source string, assigned_client string"
    record_decisions(spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), schema), str(tmp_path / "d"), str(tmp_path / "a"))
    stored = ledgers.read_aliases(spark, str(tmp_path / "a")).orderBy("alias_ord").collect()
    assert [r.alias for r in stored] == names


def test_reversal_is_no_decision(spark, tmp_path):
    requests = spark.createDataFrame([("F", "REVERTIR")], "fingerprint string, action string")
    record_decisions(requests, str(tmp_path / "d"), str(tmp_path / "a"))
    assert ledgers.read_decisions(spark, str(tmp_path / "d")).count() == 0


def test_batches_grow_whatever_the_clock_says(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "d"), spark.createDataFrame([("F", "PENDIENTE")], "fingerprint string, action string")
    ledgers.append_decisions(rows, path)
    monkeypatch.setattr(ledgers.time, "time_ns", lambda: 5)
    ledgers.append_decisions(rows.withColumn("action", F.lit("NO_CORRESPONDE")), path)
    assert last_decisions(ledgers.read_decisions(spark, path)).first().action == "NO_CORRESPONDE"


@pytest.mark.parametrize(
    "text, items",
    [
        ("""['A', "O'HARA-1"]""", ["A", "O'HARA-1"]),
        (r"['O\'HARA', 'a\\b']", ["O'HARA", "a\\b"]),
        ("[]", []),
        ("['open", []),
        (None, []),
    ],
)
def test_lists_of_either_quote(spark, text, items):
    row = spark.createDataFrame([(text,)], "t string").select(ledgers.text_list(F.col("t")).alias("x")).first()
    assert row.x == items


def test_lists_and_line_breaks_come_back_from_csv(spark, tmp_path):
    rows = [(1, ["A, B", "O'HARA", 'say "x"', "back\\slash", "two\nlines"], "a text\nof two lines, \"quoted\""), (2, [], "")]
    df = spark.createDataFrame(rows, "k int, documents array<string>, note string")
    export_csv(df, str(tmp_path / "x"))
    back = {r.k: r for r in import_csv(spark, str(tmp_path / "x"), df.schema).collect()}
    assert back[1].documents == rows[0][1] and back[1].note == rows[0][2] and back[2].documents == []


def test_client_as_typed_and_blank_client(spark):
    items = spark.createDataFrame(
        [(0, "ACME", "D1", 3), (1, "ACME", "D2", 3), (2, "OTHER", "D1", 3)],
        "item_ord long, client_norm string, document string, days_overdue int",
    )
    matches = spark.createDataFrame(
        [("ASOCIADO", " Acme ", ["D1"], 7, "manual_analista", None), ("ASOCIADO", None, ["D2"], 8, "exacto", None)],
        "match_state string, client string, documents array<string>, payment_id long, match_method string, value_date date",
    )
    paid = {r.item_ord: r.payment_id for r in consolidate_items(items, matches, join_on_client=True).collect()}
    assert paid == {0: 7, 1: 8, 2: None}
