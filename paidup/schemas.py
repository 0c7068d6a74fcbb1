"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DateType()

# The ten positional fields of a bank statement, all text.
MOVEMENTS_RAW = _struct(
    account=_S,
    branch=_S,
    reserved_1=_S,
    date_raw=_S,
    reserved_2=_S,
    amount=_S,
    code=_S,
    description=_S,
    flag=_S,
    reserved_3=_S,
)

MOVEMENTS = _struct(
    movement_ord=_L,
    account=_S,
    value_date=_D,
    amount=MONEY,
    amount_abs=MONEY,
    flow=_S,
    bank_code=T.IntegerType(),
    description=_S,
)

OPEN_ITEMS = _struct(
    item_ord=_L,
    client=_S,
    client_norm=_S,
    document=_S,
    posting_date=_D,
    due_date=_D,
    original_amount=MONEY,
    open_amount=MONEY,
    days_overdue=T.IntegerType(),
    aging_band=_S,
)

MATCH_RESULT = _struct(
    payment_id=_L,
    value_date=_D,
    amount=MONEY,
    description=_S,
    client=_S,
    match_state=_S,
    match_method=_S,
    client_method=_S,
    documents=T.ArrayType(_S),
    n_documents=_L,
    candidate_cents=_L,
    note=_S,
    fingerprint=_S,
)

ALIASES = _struct(alias=_S, real_client=_S, notes=_S, alias_ord=_L)

# Append order of the ledgers is (batch, pos): batch rises with every append, pos inside it.
DECISIONS = _struct(
    decided_at=T.TimestampType(),
    fingerprint=_S,
    origin_payment_id=_L,
    amount=MONEY,
    description=_S,
    action=_S,
    assigned_document=_S,
    assigned_client=_S,
    alias_source=_S,
    comment=_S,
    user=_S,
    decision_state=_S,
)

HISTORY = _struct(
    run_at=T.TimestampType(),
    fingerprint=_S,
    payment_date=_D,
    amount=MONEY,
    description=_S,
    initial_state=_S,
    match_method=_S,
    documents=T.ArrayType(_S),
)

# Header names of the exchange files (fixed values), with the engine's names.
DECISION_FILE_COLUMNS = {
    "fecha_decision": "decided_at",
    "huella_pago": "fingerprint",
    "id_pago_origen": "origin_payment_id",
    "monto": "amount",
    "descripcion_pago": "description",
    "accion": "action",
    "factura_asignada": "assigned_document",
    "cliente_asignado": "assigned_client",
    "alias_origen": "alias_source",
    "comentario": "comment",
    "usuario": "user",
    "estado_decision": "decision_state",
}
HISTORY_FILE_COLUMNS = {
    "fecha_corrida": "run_at",
    "huella_pago": "fingerprint",
    "fecha_pago": "payment_date",
    "monto": "amount",
    "descripcion_pago": "description",
    "estado_match_inicial": "initial_state",
    "metodo_match": "match_method",
    "facturas_asociadas": "documents",
}
ALIAS_FILE_COLUMNS = {"alias": "alias", "cliente_real": "real_client", "notas": "notes"}
ERP_FILE_COLUMNS = {
    "Tipo": "doc_type",
    "Nombre SN": "client",
    "Nº documento": "document",
    "Fecha de contabilización": "posting_date",
    "Fecha de vencimiento": "due_date",
    "Saldo vencido": "open_amount",
}
WEEKLY_COLUMNS = (
    "client",
    "document",
    "posting_date",
    "due_date",
    "original_amount",
    "open_amount",
    "future_credit",
    "raw_days",
)
