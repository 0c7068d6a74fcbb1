"""Scalar expressions against the Python ones they stand for."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paidup.config import BAND_NAMES
from paidup.functions import dates, labels, money, text
from paidup.functions.fingerprint import payment_fingerprint
from paidup.operators.aging import aging_band, worst_band
from paidup.operators.consolidate import invoice_state, priority
from tests import helpers as h


def one(spark, column, **values):
    df = spark.range(1)
    for name, (value, kind) in values.items():
        df = df.withColumn(name, F.lit(value).cast(kind))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("value", ["  a b ", "\ta ", " x　", "\x1cz\x1f", "", " \n ", "ñandú "])
def test_strip_is_python_strip(spark, value):
    assert one(spark, text.strip(F.col("v")), v=(value, "string")) == value.strip()
    assert one(spark, text.normal(F.col("v")), v=(value, "string")) == value.strip().upper()


@pytest.mark.parametrize(
    "value, want",
    [("12", 12), (" 12.5 ", 12.5), ("-0.01", -0.01), ("", None), ("n/a", None), ("1e3", 1000), (None, None)],
)
def test_money(spark, value, want):
    got = one(spark, money.parse_money(F.col("v")), v=(value, "string"))
    assert got == (None if want is None else Decimal(str(want)))


@pytest.mark.parametrize("value", [0, 7, 1234567, "1234567.5", "2.5", "-1500", "3.5"])
def test_currency(spark, value):
    assert one(spark, money.currency_text(F.col("v")), v=(str(value), "decimal(18,2)")) == f"${Decimal(str(value)):,.0f}"


def test_currency_missing(spark):
    assert one(spark, money.currency_text(F.col("v")), v=(None, "decimal(18,2)")) == "—"


@pytest.mark.parametrize(
    "value, want",
    [("20260415", (2026, 4, 15)), (" 20260415", (2026, 4, 15)), ("20261399", None), ("", None), ("x", None)],
)
def test_statement_date(spark, value, want):
    assert one(spark, dates.statement_date(F.col("v")), v=(value, "string")) == (want and dt.date(*want))


@pytest.mark.parametrize(
    "value, want",
    [("05/04/2026", (2026, 4, 5)), ("5/4/2026", (2026, 4, 5)), ("2026-04-05", (2026, 4, 5)), ("2026-04-05 00:00:00", (2026, 4, 5)),
     ("31/02/2026", None), ("nada", None)],
)
def test_day_first(spark, value, want):
    assert one(spark, dates.day_first_date(F.col("v")), v=(value, "string")) == (want and dt.date(*want))


def test_long_date(spark):
    assert one(spark, dates.long_spanish_date(F.col("v")), v=("2026-05-09", "date")) == "09 de mayo de 2026"


def test_cutoff_argument():
    day = dt.date(2026, 4, 16)
    for value in (day, dt.datetime(2026, 4, 16, 9), "2026-04-16"):
        assert dates.cutoff_date(value) == day
    assert dates.cutoff_date(None) == dt.date.today()


@pytest.mark.parametrize("amount", ["7051557.00", "4.71", "-1236094.82", "0"])
@pytest.mark.parametrize("words", ["PAGO DE PROV ALMACENES GLOBALE", " niño é ", ""])
def test_fingerprint(spark, amount, words):
    got = one(
        spark,
        payment_fingerprint(F.col("d"), F.col("a"), F.col("t")),
        d=(words, "string"),
        a=(amount, "decimal(18,2)"),
        t=(h.DAY.isoformat(), "date"),
    )
    assert got == h.fingerprint(words, amount)


@pytest.mark.parametrize(
    "days, band",
    [(-1, "AL_DIA"), (0, "0-30"), (30, "0-30"), (31, "31-60"), (60, "31-60"), (61, "61-90"), (90, "61-90"), (91, "91-120"),
     (120, "91-120"), (121, "121+"), (None, "121+")],
)
def test_band_edges(spark, days, band):
    assert one(spark, aging_band(F.col("v")), v=(days, "int")) == band


@pytest.mark.parametrize(
    "days, paid, state, level",
    [(0, True, "PAGADA", "RESUELTO"), (61, True, "PAGADA", "CRITICO"), (61, False, "VENCIDA", "CRITICO"), (31, False, "VENCIDA", "ALTO"),
     (1, False, "VENCIDA", "MEDIO"), (0, False, "AL_DIA", "BAJO"), (None, False, "AL_DIA", "BAJO"), (None, True, "PAGADA", "BAJO")],
)
def test_state_and_priority(spark, days, paid, state, level):
    values = {"p": (paid, "boolean"), "d": (days, "int")}
    assert one(spark, invoice_state(F.col("p"), F.col("d")), **values) == state
    assert one(spark, priority(F.col("p"), F.col("d")), **values) == level


def test_labels(spark):
    assert one(spark, labels.origin_label(F.col("v")), v=("exacto", "string")) == "Automático"
    assert one(spark, labels.origin_label(F.col("v")), v=("otro", "string")) == "Sin resolver"
    assert one(spark, labels.origin_label(F.col("v")), v=(None, "string")) == "Sin resolver"
    stages = ["SEMANA_0", "SEMANA_1_3", "SEMANA_1_3", "SEMANA_4", "SEMANA_5", "SEMANA_6"]
    assert [one(spark, labels.dunning_stage(F.col("v")), v=(b, "string")) for b in BAND_NAMES] == stages
    assert one(spark, labels.dunning_stage(F.col("v")), v=("?", "string")) == "SEMANA_1_3"
    assert one(spark, text.labelled("Pago", F.col("v")), v=(" x ", "string")) == "**Pago:** x"
    assert one(spark, text.labelled("Pago", F.col("v")), v=("  ", "string")) is None


def test_worst_band(spark):
    df = spark.createDataFrame([("a", "0-30"), ("a", "91-120"), ("a", "AL_DIA"), ("b", None)], "c string, band string")
    rows = {r.c: r.w for r in df.groupBy("c").agg(worst_band(F.col("band")).alias("w")).collect()}
    assert rows == {"a": "91-120", "b": "AL_DIA"}


def test_the_table_of_sums_has_a_largest_size():
    from paidup.config import MatchSettings

    assert MatchSettings().n_shapes == 6748
    with pytest.raises(ValueError, match="shapes"):
        MatchSettings(max_items_for_sums=40, max_combination=8)
