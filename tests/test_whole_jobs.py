"""Queries whose rows hold everything they name: all equal invoices, all candidates of a payment, whole letters."""

from pyspark.sql import functions as F

from paidup.config import MatchSettings
from paidup.operators.amounts import exact_hits, price_levels, priced_items
from paidup.operators.candidates import candidate_sets, candidates, of_payments, with_exact_lists
from paidup.operators.consolidate import consolidate_items
from paidup.operators.dunning import TEMPLATES, letter_bodies
from paidup.operators.worklist import candidate_labels
from paidup.schemas import MATCH_RESULT
from tests import helpers as h
from tests.test_cascade import matched

EQUAL = [("Acero", "F-3", 100, 3), ("Acero", "F-1", 100, 70), ("Acero", "F-2", 250, 5), ("Cobre", "G-1", 100, 1)]


def test_exact_hits_list_every_equal_invoice(spark):
    """the list was left out where several invoices are equal."""
    open_items = h.items(spark, EQUAL)
    asked = spark.createDataFrame([("ACERO", 10000), ("ACERO", 25000), ("COBRE", 10000)], "client_norm string, cents long")
    hits = exact_hits(asked, price_levels(priced_items(open_items)), MatchSettings())
    rows = {(r.client_norm, r.cents): (r.n_exact, r.exact) for r in with_exact_lists(hits, open_items).collect()}
    assert rows == {("ACERO", 10000): (2, ["F-3", "F-1"]), ("ACERO", 25000): (1, ["F-2"]), ("COBRE", 10000): (1, ["G-1"])}


def test_every_ambiguous_payment_has_its_labelled_candidates(spark):
    """payments that share a set of candidates had no rows of their own."""
    payments = [(100, "PAGO DE PROV ACERO"), (100, "PAGO PROV ACERO 2"), (250, "PAGO DE PROV ACERO")]
    matches = matched(spark, payments, EQUAL).cache()
    open_items = h.items(spark, EQUAL)
    rows = candidates(matches, candidate_sets(matches, open_items))
    labelled = candidate_labels(rows, consolidate_items(open_items, matches))
    got = {(r.payment_id, r.document) for r in of_payments(labelled, matches).filter("label like concat(document, '  ·  $100%')").collect()}
    assert got == {(p, d) for p in (0, 1) for d in ("F-1", "F-3")}
    matches.unpersist()


def test_a_letter_body_has_every_line(spark):
    """the lines of the table were left out of the letter."""
    none = spark.createDataFrame([], MATCH_RESULT)
    base = consolidate_items(h.items(spark, EQUAL), none)
    bodies = {r.client: r.body for r in letter_bodies(base, "2026-05-02").collect()}
    table = "| Documento | Vencimiento | Días vencido | Saldo |\n|---|---|---:|---:|\n"
    table += "| F-1 | 2026-02-05 | 70 | $100 |\n| F-2 | 2026-04-11 | 5 | $250 |\n| F-3 | 2026-04-13 | 3 | $100 |\n| **TOTAL** |  |  | **$450** |"
    assert bodies["Acero"] == TEMPLATES["SEMANA_4"].format(client="Acero", deadline="09 de mayo de 2026", table=table)
    assert "| G-1 | 2026-04-15 | 1 | $100 |" in bodies["Cobre"]


def test_payments_hold_a_derived_text_once(spark):
    """The filter on the category stays above it, so no filter holds the expression of the text for every keyword."""
    from paidup.operators.classify import classify, customer_payments

    rows = spark.range(12).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("PAGO DE PROV "), F.col("id").cast("string"))).otherwise(F.lit("ABONO INTERESES")).alias("description"),
        F.lit("ABONO").alias("flow"),
    )
    payments = customer_payments(classify(rows))
    assert sorted(r.description for r in payments.collect()) == sorted(f"PAGO DE PROV {i}" for i in range(0, 12, 2))
    plan = payments._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "PAGO DE PROV " in line]


def test_substrings_of_shapes_against_all_substrings(spark):
    from paidup.operators.docref import number_shapes, substrings_of_shapes

    numbers = ["FV-1", "FV-22", "A", "É2", "FV-1"]
    items = spark.createDataFrame([("C", n) for n in numbers] + [("C", ""), ("C", None)], "client_norm string, document string")
    texts = ["", "A", "FV", "PAGO FV-1 FV-22", "FAFV-É2A", "no number"]
    known = spark.createDataFrame([(t,) for t in texts], "description string").join(number_shapes(items))
    got = {r[0]: r[1] for r in known.select("description", substrings_of_shapes("description", "shapes", "firsts")).collect()}
    shapes = {(len(n), n[0]) for n in numbers}
    for t in texts:
        want = {t[p : p + n] for n, c in shapes for p in range(len(t) - n + 1) if t[p] == c}
        assert set(got[t]) == want and len(got[t]) == len(want)
