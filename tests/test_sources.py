"""Files in, typed tables out."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from paidup.operators.classify import classify
from paidup.sources import ledgers, outputs
from paidup.sources.ordinals import dense_positions
from paidup.sources.receivables import erp_items, read_receivables, weekly_items
from paidup.sources.statement import read_statement, rejected_lines
from tests import helpers as h


def line(day, amount, text, code="100"):
    return f" 001,  55,,{day},, {amount}, {code},  {text},0,"


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_statement_types(spark, tmp_path):
    path = write(
        tmp_path / "s.csv",
        [line("20260415", "100.50", "Pago de prov acero"), line(" 20261399", "-7", "\tx ", ""), line("20260401", "n/a", "z"), line("20260402", "0", "y")],
    )
    rows = read_statement(spark, path).orderBy("movement_ord").collect()
    assert [r.movement_ord for r in rows] == [0, 1, 2, 3]
    assert rows[0].value_date == dt.date(2026, 4, 15) and rows[0].amount == Decimal("100.50") and rows[0].account == "001"
    assert rows[0].description == "PAGO DE PROV ACERO" and rows[0].bank_code == 100
    assert rows[1].value_date is None and rows[1].flow == "CARGO" and rows[1].description == "X" and rows[1].bank_code is None
    assert rows[2].amount is None and rows[2].flow == "NULO" and rows[3].flow == "NULO"


def test_date_filter_and_counts(spark, tmp_path):
    path = write(tmp_path / "s.csv", [line(f"202604{d:02d}", "1", "a") for d in range(1, 11)] + [line("20261399", "1", "b")])
    seen = Observation()
    kept = read_statement(spark, path, "2026-04-03", "2026-04-05", observation=seen)
    assert kept.count() == 3
    assert seen.get == {"discarded": 8, "without_date": 1}
    assert read_statement(spark, path).count() == 11


@pytest.mark.parametrize("columns", [9, 11])
def test_wrong_width_is_refused(spark, tmp_path, columns):
    path = write(tmp_path / "s.csv", [",".join("x" * columns)])
    with pytest.raises(ValueError, match=f"{columns} columns"):
        read_statement(spark, path)


def test_later_lines_of_wrong_width_are_kept_apart(spark, tmp_path):
    path = write(tmp_path / "s.csv", [line("20260415", "1", "a"), "1,2,3", line("20260415", "2", "b")])
    assert read_statement(spark, path).count() == 2
    assert rejected_lines(spark, path).count() == 1


def test_missing_statement(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_statement(spark, str(tmp_path / "none.csv"))


def test_positions_follow_the_file_over_many_splits(spark, tmp_path, ws):
    for part in range(3):
        write(tmp_path / f"p{part}.csv", [line("20260415", f"{part * 4000 + i}", "text of a movement") for i in range(4000)])
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_statement(spark, str(tmp_path), ws=ws)
        assert rows.filter(F.col("movement_ord") != F.col("amount").cast("long")).count() == 0
        assert rows.select("movement_ord").distinct().count() == 12000
        dense = dense_positions(rows.filter("movement_ord % 3 = 1"), "movement_ord", "pos", ws)
        assert dense.filter(F.col("pos") * 3 + 1 != F.col("movement_ord")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


SHEET = [
    "Cartera,,,,,,",
    "Corte,,,,,,",
    "Cliente,Documento,Fecha,Vence,Original,Saldo,Abono",
    " Acero SAS ,123.0,01/02/2026,15/03/2026,100,90,0",
    "Acero SAS,10.05,2026-02-01,2026-04-16,100,50.5,0",
    "Acero SAS,FV-9,01/02/2026,malo,x,10,0",
    ",FV-1,01/02/2026,15/03/2026,100,90,0",
    "Sur,FV-2,01/02/2026,15/03/2026,100,0,0",
    "Sur,FV-3,01/02/2026,15/03/2026,100,n/a,0",
]


def test_weekly_sheet(spark, tmp_path):
    rows = read_receivables(spark, write(tmp_path / "w.csv", SHEET), h.CUTOFF).orderBy("item_ord").collect()
    assert [r.document for r in rows] == ["123", "10.05", "FV-9"]
    assert rows[0].client == "Acero SAS" and rows[0].client_norm == "ACERO SAS" and rows[0].days_overdue == 32
    assert rows[1].due_date == dt.date(2026, 4, 16) and rows[1].days_overdue == 0 and rows[1].aging_band == "0-30"
    assert rows[2].due_date is None and rows[2].days_overdue is None and rows[2].aging_band == "121+"
    assert rows[2].original_amount is None


def test_weekly_sheet_other_skip_and_eight_columns(spark, tmp_path):
    path = write(tmp_path / "w.csv", [x + ",30" for x in SHEET])
    assert read_receivables(spark, path, h.CUTOFF, skip_rows=2).count() == 3
    assert read_receivables(spark, path, h.CUTOFF, skip_rows=4).count() == 2


def test_erp_export_is_recognised(spark, tmp_path):
    head = "Tipo,Nombre SN,Nº documento,Fecha de contabilización,Fecha de vencimiento,Saldo vencido"
    lines = [head, "RF, Acero ,77,1/2/2026,15/03/2026,90", "NC,Acero,78,1/2/2026,15/03/2026,90", "RF,Acero,79,1/2/2026,15/03/2026,-1", "RF,,80,1/2/2026,15/03/2026,5"]
    rows = read_receivables(spark, write(tmp_path / "e.csv", lines), h.CUTOFF).collect()
    assert len(rows) == 1
    assert rows[0].document == "77" and rows[0].original_amount == rows[0].open_amount == Decimal("90.00")
    assert rows[0].posting_date == dt.date(2026, 2, 1)


def test_parquet_receivables(spark, tmp_path):
    path = str(tmp_path / "e.parquet")
    data = [("RF", "Acero", "77", dt.date(2026, 2, 1), dt.date(2026, 3, 15), 90.0)]
    names = ["Tipo", "Nombre SN", "Nº documento", "Fecha de contabilización", "Fecha de vencimiento", "Saldo vencido"]
    spark.createDataFrame(data, names).write.parquet(path)
    rows = read_receivables(spark, path, h.CUTOFF, file_format="parquet").collect()
    assert rows[0].days_overdue == 32 and rows[0].open_amount == Decimal("90.00")


def test_alias_file(spark, tmp_path):
    from paidup.operators.identify import alias_catalogue

    path = write(tmp_path / "a.csv", ["alias,cliente_real,notas", "# comentario", " alfa ,uno,", "beta,dos,", "ALFA,tres,", ",cuatro,"])
    rows = alias_catalogue(ledgers.read_alias_file(spark, path)).orderBy("alias_ord").collect()
    assert [(r.alias, r.real_client) for r in rows] == [("ALFA", "TRES"), ("BETA", "DOS")]
    assert ledgers.read_alias_file(spark, str(tmp_path / "none.csv")).count() == 0


def test_decision_file_without_state(spark, tmp_path):
    head = "fecha_decision,huella_pago,id_pago_origen,monto,descripcion_pago,accion,factura_asignada,cliente_asignado,alias_origen,comentario,usuario"
    path = write(tmp_path / "d.csv", [head, "2026-04-01 10:00:00,aa,3.0,12.50,txt,PENDIENTE,,,,,ana", "2026-04-02 10:00:00,aa,3,12.5,txt,NO_CORRESPONDE, ,x,,,ana"])
    rows = ledgers.read_decision_file(spark, path).orderBy("decision_ord").collect()
    assert [r.decision_state for r in rows] == ["ACTIVA", "ACTIVA"]
    assert rows[0].origin_payment_id == 3 and rows[0].amount == Decimal("12.50") and rows[1].assigned_document is None


def test_history_file(spark, tmp_path):
    head = "fecha_corrida,huella_pago,fecha_pago,monto,descripcion_pago,estado_match_inicial,metodo_match,facturas_asociadas"
    path = write(tmp_path / "h.csv", [head, "2026-04-01 10:00:00,aa,2026-03-31,5,t,ASOCIADO,acumulado,\"['A', 'B']\"", "2026-04-01 10:00:00,bb,2026-03-31,5,t,ASOCIADO,exacto,roto"])
    rows = {r.fingerprint: r.documents for r in ledgers.read_history_file(spark, path).collect()}
    assert rows == {"aa": ["A", "B"], "bb": []}


def test_missing_ledgers_are_empty(spark, tmp_path):
    assert ledgers.read_decisions(spark, str(tmp_path / "d")).count() == 0
    assert ledgers.read_history(spark, str(tmp_path / "h")).count() == 0
    assert ledgers.read_aliases(spark, str(tmp_path / "a")).count() == 0


def test_csv_round_trip_of_lists(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("documents", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(1, ["A", "B"]), (2, []), (3, None)], schema)
    outputs.export_csv(df, str(tmp_path / "out"))
    rows = {r.id: r.documents for r in outputs.import_csv(spark, str(tmp_path / "out"), schema).collect()}
    assert rows == {1: ["A", "B"], 2: [], 3: []}


CATEGORY_CASES = [
    (100, "PAGO DE PROV X", "PAGO_CLIENTE"),
    (100, "PAGO INTERBANC X", "PAGO_CLIENTE"),
    (-5, "PAGO A PROVE X", "EGRESO_PROVEEDOR"),
    (-5, "DEBITO POR ABONO CARTERA", "AJUSTE_CONTABLE"),
    ("4.71", "ABONO INTERESES AHORROS", "INTERESES_BANCO"),
    (-5, "COMISION PAGO A PROVEEDORES", "EGRESO_PROVEEDOR"),
    (-5, "IMPTO GOBIERNO 4X1000", "IMPUESTO"),
    (5, "CUENTA ACTIVA", "IMPUESTO"),
    (-5, "PAGO DE PROV X", "OTRO_EGRESO"),
    (-5, "NOMINA", "EGRESO_NOMINA"),
    (5, "NOMINA", "PAGO_CLIENTE"),
    (0, "COSA", "OTRO_EGRESO"),
    (-5, None, "OTRO_EGRESO"),
    (5, None, "PAGO_CLIENTE"),
]


def test_categories(spark):
    rows = classify(h.movements(spark, [(a, t) for a, t, _ in CATEGORY_CASES])).orderBy("movement_ord").collect()
    assert [r.category for r in rows] == [c for _, _, c in CATEGORY_CASES]


def test_weekly_sheet_needs_seven_columns(spark):
    with pytest.raises(ValueError):
        weekly_items(spark.createDataFrame([(0, "a", "b")], "item_ord long, a string, b string"))
    assert erp_items is not None
