"""The cascade against a plain loop, on random and on edge inputs."""

import random

import pytest
from pyspark.sql import functions as F

from paidup.config import NOTES, MatchSettings, SkewSettings
from paidup.operators import cascade as cascade_module, docref as docref_module
from paidup.operators.candidates import candidate_sets, candidates, with_lists
from paidup.operators.cascade import match_counters, match_payments
from paidup.operators.classify import classify
from paidup.operators.consolidate import consolidate_items, exceptions_of
from paidup.operators.worklist import allowed, decision_options
from paidup.skew import hot_keys
from tests import helpers as h

WORDS = ["TRANSPORTES", "NORTE", "LTDA", "SAS", "QUIMICOS", "SUR", "ABC", "ACERO", "NATION_1", "NATION_10", "CO"]


def matched(spark, payments, receivables, alias_rows=(), decision_rows=(), seen=(), settings=MatchSettings()):
    movements = h.movements(spark, payments).withColumn("category", F.lit("PAGO_CLIENTE"))
    return match_payments(
        movements,
        h.items(spark, receivables),
        h.aliases(spark, alias_rows),
        h.decisions(spark, decision_rows),
        h.history(spark, seen),
        settings,
    )


def run(spark, payments, receivables, *more, **settings):
    """The cascade, with all candidates in the rows."""
    return with_lists(matched(spark, payments, receivables, *more, **settings), h.items(spark, receivables))


def random_case(seed):
    rng = random.Random(seed)
    clients = list({" ".join(rng.sample(WORDS, rng.randint(1, 3))) for _ in range(12)}) + ["AB"]
    receivables = []
    for i in range(90):
        client = clients[0] if rng.random() < 0.25 else rng.choice(clients)
        receivables.append((client, f"FV-{i if rng.random() < 0.9 else rng.randint(0, 20)}", rng.randint(1, 25) * 100, rng.randint(-20, 150)))
    alias_rows = [("ALFA", clients[1]), ("x", "SIN CARTERA"), ("GRUPO BETA UNO", clients[2]), ("ALFA", clients[3]), ("", "NADIE")]
    payments = []
    for i in range(150):
        client, doc, amount, _ = rng.choice(receivables)
        text = rng.choice(
            [f"PAGO DE PROV {client}", f"PAGO {client[:14]}", f"TRANSFER ALFA {i}", f"GRUPO BETA UNO {i}", f"ABONO {i}",
             f"REF {doc} {client}", "", f"PAGO AB{i}", "DEPOSITO X"]
        )
        extra = rng.choice([0, 0, 1, -1, 1.01, 33, 100, 300])
        payments.append((amount + extra, text if rng.random() < 0.97 else None))
    decision_rows, seen = [], set()
    for amount, text in payments[:60]:
        fp = h.fingerprint(text, amount)
        action = rng.choice(
            ["APLICAR_FACTURA", "APLICAR_FACTURA", "PAGO_PARCIAL", "PENDIENTE", "NO_CORRESPONDE", "CLIENTE_NUEVO", "AGREGAR_ALIAS"]
        )
        document = rng.choice([receivables[0][1], rng.choice(receivables)[1], "FV-GONE", None]) if action == "APLICAR_FACTURA" else None
        decision_rows.append(
            {"fingerprint": fp, "action": action, "assigned_document": document, "assigned_client": clients[1], "decision_state": "ACTIVA"}
        )
        if rng.random() < 0.2:
            decision_rows.append({"fingerprint": fp, "action": "REVERTIR", "decision_state": "REVERTIDA"})
    for amount, text in payments[50:70]:
        seen.add(h.fingerprint(text, amount))
    return payments, receivables, alias_rows, decision_rows, seen


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_inputs_match_the_plain_loop(spark, seed):
    payments, receivables, alias_rows, decision_rows, seen = random_case(seed)
    got = h.outcomes(run(spark, payments, receivables, alias_rows, decision_rows, seen))
    want = h.plain_cascade(payments, receivables, alias_rows, decision_rows, seen)
    assert got == want
    assert len({m for _, m, _, _, _ in want}) >= 8


def test_same_results_when_every_key_is_treated_as_hot(spark, monkeypatch):
    payments, receivables, alias_rows, decision_rows, seen = random_case(4)

    def all_hot(df, *keys, **_):
        return [[r[0] for r in df.select(F.xxhash64(*key)).distinct().collect()] for key in keys]

    for module in (cascade_module, docref_module):
        monkeypatch.setattr(module, "hot_keys", all_hot)
    got = h.outcomes(run(spark, payments, receivables, alias_rows, decision_rows, seen))
    assert got == h.plain_cascade(payments, receivables, alias_rows, decision_rows, seen)


def test_tolerance_edge_is_inclusive(spark):
    receivables = [("ACERO", "F-1", 100, 1)]
    got = h.outcomes(run(spark, [(101, "ACERO"), ("101.01", "ACERO"), (99, "ACERO"), ("98.99", "ACERO")], receivables))
    assert [g[1] for g in got] == ["exacto", "ninguno", "exacto", "ninguno"]


@pytest.mark.parametrize("n, method", [(15, "acumulado"), (16, "ninguno")])
def test_sums_stop_at_fifteen_items(spark, n, method):
    receivables = [("ACERO", f"D{i}", 1000 * 3**i, 1) for i in range(n)]
    total = 1000 * (3**0 + 3**1 + 3**5 + 3**9)
    got = h.outcomes(run(spark, [(total, "ACERO")], receivables))
    assert got[0][1] == method
    if n == 15:
        assert got[0][4] == ["D0", "D1", "D5", "D9"]


def test_no_customer_payments_gives_an_empty_result(spark):
    movements = classify(h.movements(spark, [(-5, "PAGO A PROV X")]))
    result = match_payments(
        movements, h.items(spark, [("ACERO", "A", 1, 1)]), h.aliases(spark), h.decisions(spark), h.history(spark)
    )
    assert result.count() == 0 and "match_state" in result.columns


def test_alias_of_a_client_without_receivables(spark):
    result = run(spark, [(5, "ACERO")], [("ZZZZ", "Y", 1, 1)], [("ACERO", "ACERO SAS")])
    assert h.outcomes(result) == [("NO_IDENTIFICADO", "ninguno", "alias", "ACERO SAS", [])]


def test_missing_date_never_equals_a_ledger_row(spark):
    result = run(spark, [(100, "ACERO", None), (100, "ACERO")], [("ACERO", "A", 100, 1)], seen=[h.fingerprint("ACERO", 100)])
    rows = result.orderBy("payment_id").collect()
    assert rows[0].fingerprint is None and rows[0].match_method == "exacto"
    assert rows[1].match_state == "YA_PROCESADO"


def test_equal_payments_are_independent(spark):
    got = h.outcomes(run(spark, [(100, "ACERO"), (100, "ACERO")], [("ACERO", "A", 100, 1)]))
    assert [g[4] for g in got] == [["A"], ["A"]]


def test_notes_and_counters(spark):
    receivables = [("ACERO", "A", 100, 1), ("ACERO", "B", 100, 1), ("ACERO", "C", 300, 1)]
    fp = h.fingerprint("ACERO", 7)
    result = run(
        spark,
        [(100, "ACERO"), (400, "ACERO"), (7, "ACERO")],
        receivables,
        decision_rows=[{"fingerprint": fp, "action": "PENDIENTE", "decision_state": "ACTIVA"}],
    )
    rows = result.orderBy("payment_id").collect()
    assert rows[0].note == NOTES["exacto_multiple"].replace("{n}", "2") and rows[0].documents == ["A", "B"]
    assert rows[1].note == NOTES["acumulado_multiple"].replace("{n}", "2") and rows[1].documents == ["A", "C"]
    assert match_counters(result).first().asDict() == {"decisions_applied": 1, "already_processed": 0}


@pytest.mark.parametrize("n", [3, 250])
def test_equal_invoices_are_one_set_for_all_payments(spark, n):
    receivables = [("ACERO", f"D{i}", 100, 1) for i in range(n)] + [("ACERO", "E", "100.50", 1), ("ACERO", "F", 200, 1), ("COBRE", "G", 100, 1)]
    items = h.items(spark, receivables)
    matches = matched(spark, [(100, "ACERO"), (100, "ACERO"), (101, "ACERO"), (200, "ACERO"), (77, "COBRE")], receivables)
    rows = matches.orderBy("payment_id").collect()
    assert [(r.match_method, r.n_documents, r.documents, r.candidate_cents) for r in rows] == [
        ("exacto_multiple", n + 1, [], 10000),
        ("exacto_multiple", n + 1, [], 10000),
        ("exacto_multiple", n + 1, [], 10100),
        ("exacto", 1, ["F"], None),
        ("ninguno", 0, [], None),
    ]
    sets = candidate_sets(matches, items)
    found = [tuple(r)[:2] + (r.document,) for r in sets.orderBy("cents", "item_ord").collect()]
    own = [f"D{i}" for i in range(n)] + ["E"]
    assert found == [("ACERO", c, d) for c in (10000, 10100) for d in own]
    assert candidates(matches, sets).count() == 2 * (n + 1)
    assert h.outcomes(with_lists(matches, items))[2][4] == own

    exceptions = exceptions_of(matches)
    options = decision_options(exceptions, consolidate_items(items, matches), sets)
    assert options.filter("action = 'APLICAR_FACTURA' AND document IS NULL").count() == 0
    assert options.filter("action = 'APLICAR_FACTURA' AND cents = 10000").count() == n + 1
    assert [r.document for r in options.filter("client = 'COBRE' AND document IS NOT NULL").collect()] == ["G"]
    asked = [(0, "APLICAR_FACTURA", "D1"), (1, "APLICAR_FACTURA", "F"), (2, "APLICAR_FACTURA", "E"), (2, "PENDIENTE", None),
             (4, "APLICAR_FACTURA", "G"), (4, "APLICAR_FACTURA", "D1"), (4, "PAGO_PARCIAL", None), (0, "PAGO_PARCIAL", None)]
    requests = spark.createDataFrame(asked, "payment_id long, action string, document string")
    good = {tuple(r) for r in allowed(requests, exceptions, options).collect()}
    assert good == {asked[0], asked[2], asked[3], asked[4], asked[6]}


@pytest.mark.parametrize("n", [1, 199, 260])
def test_a_number_of_many_invoices_is_quoted_alike_at_any_size(spark, n):
    receivables = [("ACERO", "FV-9", 10 + i, 1) for i in range(n)] + [("ACERO", "FV-1", 7000, 1)]
    row = matched(spark, [(99999, "ACERO FV-9 FV-1 FV-9")], receivables).first()
    assert (row.match_method, row.documents, row.n_documents) == ("referencia", ["FV-9", "FV-1"], n + 1)
    assert h.outcomes(run(spark, [(99999, "ACERO FV-9 FV-1 FV-9")], receivables))[0][4] == ["FV-9"] * n + ["FV-1"]


@pytest.mark.parametrize("extra", [0, 70])
def test_repeated_numbers_are_all_quoted(spark, extra):
    receivables = [("ACERO", "FV-1", 100, 1), ("ACERO", "FV-2", 200, 1), ("ACERO", "FV-1", 700, 1)]
    receivables += [("ACERO", f"ZZ-{i}", 10, 1) for i in range(extra)]
    got = h.outcomes(run(spark, [(5555, "ACERO FV-1 FV-2 FV-1"), (5556, "ACERO fv-1")], receivables))
    assert got[0][4] == ["FV-1", "FV-2", "FV-1"]
    assert got[1][1] == "ninguno"


def test_hot_keys_are_found(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    (hot,) = hot_keys(df, ["k"], settings=SkewSettings(min_rows=1000))
    want = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long"))).first()[0]
    assert hot == [want]
