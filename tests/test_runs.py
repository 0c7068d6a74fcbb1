"""Whole runs on files: the two scenarios, ledgers between runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paidup.config import RunSettings
from paidup.operators import reports
from paidup.operators.candidates import with_lists
from paidup.operators.dunning import TEMPLATES, dunning_letters, dunning_lines, letter_rows, write_letters
from paidup.operators.ledger import rejected_decisions
from paidup.plans.reconcile import RunPaths, reconcile, record_decisions, revert_decisions, run_reconciliation
from paidup.sources import ledgers, outputs
from paidup.workspace import Workspace
from tests import helpers as h

# Scenario A: client, document, open amount, days overdue at 2026-04-16.
RECEIVABLES = [
    ("ALMACENES GLOBALES SA", "FV-1010", 7051557, 10),
    ("ALMACENES GLOBALES SA", "FV-1011", 3800000, 45),
    ("TRANSPORTES DEL NORTE SAS", "FV-1001", 4500000, 5),
    ("TRANSPORTES DEL NORTE SAS", "FV-1002", 2300000, 25),
    ("TRANSPORTES DEL NORTE SAS", "FV-1003", 1200000, 25),
    ("COMERCIALIZADORA PACIFIC SAS", "FV-1020", 5000000, 8),
    ("COMERCIALIZADORA PACIFIC SAS", "FV-1021", 3000000, 8),
    ("COMERCIALIZADORA PACIFIC SAS", "FV-1022", 2000000, 35),
    ("LOGISTICA INTEGRADA CO SAS", "FV-1040", 1500000, 15),
    ("LOGISTICA INTEGRADA CO SAS", "FV-1041", 1500000, 20),
    ("QUIMICOS ANDINOS SAS", "FV-1070", 2800000, 55),
    ("INDUSTRIAS METALICAS DEL SUR SAS", "FV-1030", 12500000, 70),
    ("INDUSTRIAS METALICAS DEL SUR SAS", "FV-1031", 8900000, 130),
    ("EMPAQUES Y SOLUCIONES SAS", "FV-1050", 6200000, -5),
    ("EMPAQUES Y SOLUCIONES SAS", "FV-1051", 4100000, -10),
    ("DISTRIBUIDORA CENTRAL LTDA", "FV-1060", 9500000, 95),
    ("DISTRIBUIDORA CENTRAL LTDA", "FV-1061", 3200000, 40),
]
STATEMENT = [
    ("7051557.00", "PAGO DE PROV ALMACENES GLOBALE"),
    ("3500000.00", "PAGO INTERBANC TRANSPORTES DEL"),
    ("8000000.00", "PAGO DE PROV COMERCIALIZADORA"),
    ("1500000.00", "PAGO DE PROV LOGISTICA INTEGRA"),
    ("4200000.00", "PAGO DE PROV TEXTILES MODERNOS"),
    ("1500000.00", "PAGO INTERBANC QUIMICOS ANDINO"),
    ("-2750081.00", "PAGO A PROVE UNO"),
    ("-748800.00", "PAGO A PROVE DOS"),
    ("-5644980.00", "PAGO A PROVE TRES"),
    ("-113199.00", "PAGO A PROV CUATRO"),
    ("-1236094.82", "DEBITO POR ABONO CARTERA"),
    ("4.71", "ABONO INTERESES AHORROS"),
    ("-85000.00", "COMISION PAGO A PROVEEDORES"),
    ("-32000.00", "IMPTO GOBIERNO 4X1000"),
]
MATCHES = [
    ("0913077b30d2f4c0", "ASOCIADO", "exacto", ["FV-1010"]),
    ("ec20abcd0bca34a3", "ASOCIADO", "acumulado", ["FV-1002", "FV-1003"]),
    ("c3367d2e9578e825", "ASOCIADO", "acumulado", ["FV-1020", "FV-1021"]),
    ("6c305aee178bf264", "AMBIGUO", "exacto_multiple", ["FV-1040", "FV-1041"]),
    ("19b251ab8b324cc8", "CLIENTE_DESCONOCIDO", "ninguno", []),
    ("13f2e75a2e45df6e", "NO_IDENTIFICADO", "ninguno", []),
]


@pytest.fixture()
def paths(tmp_path):
    statement = [f"123, 1,, 20260415,, {amount}, 77, {text} ,0," for amount, text in STATEMENT]
    (tmp_path / "statement.csv").write_text("\n".join(statement) + "\n", encoding="utf-8")
    sheet = ["Cartera,,,,,,", "Cliente,Documento,Fecha,Vence,Original,Saldo,Abono"]
    for client, document, amount, days in RECEIVABLES:
        due = (h.CUTOFF - dt.timedelta(days=days)).strftime("%d/%m/%Y")
        sheet.append(f"{client},{document},01/01/2026,{due},{amount},{amount},0")
    (tmp_path / "sheet.csv").write_text("\n".join(sheet) + "\n", encoding="utf-8")
    names = ("aliases", "decisions", "history", "output")
    return RunPaths(str(tmp_path / "statement.csv"), str(tmp_path / "sheet.csv"), *[str(tmp_path / n) for n in names])


def counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_scenario_a(spark, paths):
    result = run_reconciliation(spark, paths, RunSettings(cutoff=h.CUTOFF, skip_rows=2))
    assert counts(result.movements.transform(lambda d: d), "flow") == {"ABONO": 7, "CARGO": 7}
    rows = result.matches.orderBy("payment_id").collect()
    listed = with_lists(result.matches, result.open_items).orderBy("payment_id").collect()
    assert [(r.fingerprint, r.match_state, r.match_method, r.documents) for r in listed] == MATCHES
    assert [r.client_method for r in rows] == ["directo"] * 4 + ["ninguno", "directo"]

    base = outputs.read_table(spark, f"{paths.output}/consolidated", outputs.CONSOLIDATED)
    assert reports.portfolio_summary(base).first().open_balance == 79051557
    assert [r.invoices for r in reports.aging_distribution(base).collect()] == [2, 8, 4, 1, 1, 1]
    assert counts(base, "priority") == {"CRITICO": 3, "ALTO": 4, "MEDIO": 8, "BAJO": 2}
    assert base.filter("is_paid").count() == 5
    assert [r.document for r in reports.critical_top(base).collect()] == ["FV-1031", "FV-1060", "FV-1030"]
    assert reports.critical_summary(base).first().critical_balance == 30900000
    exceptions = outputs.read_table(spark, f"{paths.output}/exceptions", outputs.EXCEPTIONS)
    assert exceptions.count() == 3
    assert ledgers.read_history(spark, paths.history).count() == 3

    again = run_reconciliation(spark, paths, RunSettings(cutoff=h.CUTOFF, skip_rows=2))
    assert counts(again.matches, "match_state")["YA_PROCESADO"] == 3
    assert again.base.filter("is_paid").count() == 0
    assert ledgers.read_history(spark, paths.history).count() == 3


def test_scenario_a_with_three_title_rows(spark, paths):
    result = run_reconciliation(spark, paths, RunSettings(cutoff=h.CUTOFF, skip_rows=3))
    first = result.matches.orderBy("payment_id").first()
    assert (first.match_state, first.match_method, first.documents) == ("NO_IDENTIFICADO", "ninguno", [])
    assert reports.portfolio_summary(result.base).first().open_balance == 72000000
    assert [r.invoices for r in reports.aging_distribution(result.base).collect()] == [2, 7, 4, 1, 1, 1]
    assert result.base.filter("is_paid").count() == 4 and result.exceptions.count() == 4


def test_nothing_left_after_the_date_filter(spark, paths):
    assert run_reconciliation(spark, paths, RunSettings(cutoff=h.CUTOFF, date_from="2026-05-01")) is None


def test_learning_loop(spark, tmp_path):
    client = "LOGISTICA TRANSPORTES SOLANO SAS"
    both = [(client, "F-001", 1000000, 5), (client, "F-002", 2000000, 5)]
    payments = [(1000000, "TRANSFER ALFA REF 8821"), (2000000, f"PAGO DE PROV {client} REF 9912")]
    alias_path, decision_path = str(tmp_path / "aliases"), str(tmp_path / "decisions")

    def run(rows):
        return h.outcomes(
            reconcile(
                h.movements(spark, payments),
                h.items(spark, rows),
                ledgers.read_aliases(spark, alias_path),
                ledgers.read_decisions(spark, decision_path),
                h.history(spark),
                RunSettings(cutoff=h.CUTOFF),
            ).matches
        )

    def decide(**values):
        values = {"fingerprint": h.fingerprint(payments[0][1], payments[0][0]), "description": payments[0][1], **values}
        record_decisions(spark.createDataFrame([values]), decision_path, alias_path)

    exact = ("ASOCIADO", "exacto", "directo", client, ["F-002"])
    assert run(both) == [("CLIENTE_DESCONOCIDO", "ninguno", "ninguno", None, []), exact]
    decide(action="AGREGAR_ALIAS", assigned_client=client, alias_source="Transfer Alfa")
    decide(action="AGREGAR_ALIAS", assigned_client="OTRO", alias_source="TRANSFER ALFA")
    assert ledgers.read_aliases(spark, alias_path).count() == 1
    assert run(both) == [("ASOCIADO", "exacto", "alias", client, ["F-001"]), exact]
    decide(action="APLICAR_FACTURA", assigned_document="F-001", assigned_client=client)
    assert run(both[1:])[0] == ("NO_IDENTIFICADO", "ninguno", "alias", client, [])
    assert run(both)[0] == ("ASOCIADO", "manual_analista", "manual", client, ["F-001"])

    fp = h.fingerprint(payments[0][1], payments[0][0])
    outcome = revert_decisions(spark.createDataFrame([(fp, ""), ("none", "")], "fingerprint string, comment string"), decision_path)
    accepted = {r.fingerprint: (r.accepted, r.comment) for r in outcome.collect()}
    assert accepted == {fp: (True, "Reversión de decisión previa (APLICAR_FACTURA)."), "none": (False, None)}
    assert run(both)[0] == ("ASOCIADO", "exacto", "alias", client, ["F-001"])
    again = revert_decisions(spark.createDataFrame([(fp,)], "fingerprint string"), decision_path)
    assert not again.first().accepted


def test_alias_decisions_cannot_be_reverted_or_lack_a_client(spark, tmp_path):
    rows = [("aa", "AGREGAR_ALIAS", "ALFA", "ACERO"), ("bb", "AGREGAR_ALIAS", "BETA", " "), ("cc", "RARO", None, None)]
    requests = spark.createDataFrame(rows, "fingerprint string, action string, alias_source string, assigned_client string")
    paths = str(tmp_path / "d"), str(tmp_path / "a")
    record_decisions(requests, *paths)
    assert ledgers.read_decisions(spark, paths[0]).count() == 1
    assert {r.fingerprint: r.problem for r in rejected_decisions(requests).collect()} == {
        "bb": "alias without client",
        "cc": "unknown action",
    }
    outcome = revert_decisions(spark.createDataFrame([("aa",)], "fingerprint string"), paths[0])
    assert not outcome.first().accepted


def test_reverting_a_processed_payment_does_not_reopen_it(spark):
    from paidup.operators.ledger import reversals

    rows = h.decisions(spark, [{"fingerprint": f, "action": "PENDIENTE", "decision_state": "ACTIVA"} for f in ("aa", "bb")])
    asked = spark.createDataFrame([("aa",), ("bb",)], "fingerprint string")
    outcome = reversals(rows, asked, F.lit(dt.datetime(2026, 4, 16)), h.history(spark, ["aa"]))
    assert {r.fingerprint: (r.accepted, r.reopens) for r in outcome.collect()} == {"aa": (True, False), "bb": (True, True)}


def test_same_document_under_two_clients(spark):
    rows = [("ACERO", "F-1", 100, 1), ("COBRE", "F-1", 100, 1)]
    args = h.movements(spark, [(100, "ACERO")]), h.items(spark, rows), h.aliases(spark), h.decisions(spark), h.history(spark)
    paid = [r.is_paid for r in reconcile(*args).base.orderBy("item_ord").collect()]
    assert paid == [True, True]
    strict = reconcile(*args, RunSettings(join_on_client=True)).base
    assert [r.is_paid for r in strict.orderBy("item_ord").collect()] == [True, False]


def test_dense_payment_ids(spark):
    rows = [(-5, "PAGO A PROV"), (100, "ACERO"), (-1, "X"), (200, "ACERO")]
    args = h.movements(spark, rows), h.items(spark, [("ACERO", "F-1", 100, 1)]), h.aliases(spark), h.decisions(spark), h.history(spark)
    assert [r.payment_id for r in reconcile(*args).matches.orderBy("payment_id").collect()] == [1, 3]
    dense = reconcile(*args, RunSettings(dense_payment_ids=True)).matches
    assert [(r.payment_id, r.amount) for r in dense.orderBy("payment_id").collect()] == [(0, 100), (1, 200)]


def base_of(spark, rows):
    from paidup.operators.consolidate import consolidate_items

    empty = spark.createDataFrame([], outputs.MATCH_RESULT)
    return consolidate_items(h.items(spark, rows), empty)


def test_letters(spark):
    base = base_of(spark, [("Acero", "F-1", 1000, 3), ("Acero", "F-2", 2500000, 70), ("Cobre", "G-1", 5, -2), ("Cobre", "G-2", 6, None)])
    letters, lines = dunning_letters(base, "2026-05-02"), dunning_lines(base, Workspace(spark))
    rows = {r.client: r for r in letters.collect()}
    acero, cobre = rows["Acero"], rows["Cobre"]
    assert (acero.worst_band, acero.stage, acero.invoices) == ("61-90", "SEMANA_4", 2)
    body = bodies(letter_rows(letters, lines))
    table = [x for x in body["Acero"].splitlines() if x.startswith("|")]
    assert table[2:] == [
        "| F-2 | 2026-02-05 | 70 | $2,500,000 |",
        "| F-1 | 2026-04-13 | 3 | $1,000 |",
        "| **TOTAL** |  |  | **$2,501,000** |",
    ]
    text = TEMPLATES["SEMANA_4"].format(client="Acero", deadline="09 de mayo de 2026", table="\n".join(table))
    assert body["Acero"] == text and "Acero" in acero.subject
    assert (cobre.worst_band, cobre.stage) == ("121+", "SEMANA_6") and "| G-2 |  |  | $6 |" in body["Cobre"]


def bodies(rows):
    found = {}
    for r in rows.orderBy("client", "pos").collect():
        found.setdefault(r.client, []).append(r.text)
    return {client: "\n".join(text) for client, text in found.items()}


def test_a_long_letter_is_one_document_in_order(spark, tmp_path):
    """7,000 invoices of one client, ties in days and documents: one letter, sorted without gathering the client."""
    rows = [("Acero", f"F-{i // 2}", 10, i % 5 if i % 7 else None) for i in range(7000)] + [("Cobre", "G-1", 5, 1)]
    base = base_of(spark, rows)
    letters, lines = dunning_letters(base, "2026-05-02"), dunning_lines(base, Workspace(spark))
    got = [(r.pos, r.line.split(" | ")[0][2:], r.line.split(" | ")[2]) for r in lines.filter("client = 'Acero'").orderBy("pos").collect()]
    assert [p for p, _, _ in got] == list(range(1, 7001))
    days = lambda i: -1 if i % 7 == 0 else i % 5
    want = sorted(range(7000), key=lambda i: (-days(i) if days(i) >= 0 else 1, f"F-{i // 2}", i))
    assert [(d, n) for _, d, n in got] == [(f"F-{i // 2}", str(days(i)) if days(i) >= 0 else "") for i in want]
    write_letters(letters, lines, str(tmp_path / "letters"))
    stored = spark.read.parquet(str(tmp_path / "letters"))
    assert stored.count() == 7001 + 4 and bodies(stored)["Cobre"].count("TOTAL") == 1
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan


def test_the_run_writes_its_candidate_sets(spark, paths):
    result = run_reconciliation(spark, paths, RunSettings(cutoff=h.CUTOFF, skip_rows=2))
    stored = spark.read.parquet(f"{paths.output}/candidate_sets")
    named = result.matches.filter("candidate_cents IS NOT NULL").select("client", "candidate_cents").distinct().count()
    assert stored.select("client_norm", "cents").distinct().count() == named
