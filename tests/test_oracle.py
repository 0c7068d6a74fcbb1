"""Every registered query against its SQL counterpart in DuckDB."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted_rows(df.select(*columns).collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    assert sorted(d[0] for d in cursor.description) == columns
    want = sorted_rows(duck.execute(f"SELECT {', '.join(columns)} FROM ({contract.oracle_sql()[name]})").fetchall())
    assert got == want


def test_every_query_has_sql():
    """All of the engine's own queries; the text operators have no SQL and are tested in tests/llm."""
    assert set(catalog.queries()) <= set(contract.oracle_sql())


# Independent counts of the cascade on the smallest data: state, method, client method.
GOLDEN = {
    ("AMBIGUO", "acumulado_multiple", "directo"): 35,
    ("AMBIGUO", "exacto_multiple", "alias"): 2,
    ("AMBIGUO", "exacto_multiple", "directo"): 1,
    ("AMBIGUO", "manual_conflicto", "manual"): 13,
    ("ASOCIADO", "acumulado", "directo"): 178,
    ("ASOCIADO", "exacto", "alias"): 58,
    ("ASOCIADO", "exacto", "directo"): 204,
    ("ASOCIADO", "manual_analista", "manual"): 9,
    ("ASOCIADO", "referencia", "directo"): 84,
    ("CLIENTE_DESCONOCIDO", "ninguno", "ninguno"): 187,
    ("NO_APLICA", "manual_no_aplica", "manual"): 8,
    ("NO_IDENTIFICADO", "manual_cliente_nuevo", "manual"): 9,
    ("NO_IDENTIFICADO", "manual_parcial", "manual"): 10,
    ("NO_IDENTIFICADO", "ninguno", "directo"): 87,
    ("NO_IDENTIFICADO", "ninguno", "alias"): 81,
    ("PENDIENTE_ANALISTA", "manual_pendiente", "manual"): 8,
    ("YA_PROCESADO", "historial", "historial"): 33,
}


def test_cascade_counts(spark):
    rows = contract.queries()["match_state_counts"](spark, SF_DIR).collect()
    assert {tuple(r[:3]): r[3] for r in rows} == GOLDEN
