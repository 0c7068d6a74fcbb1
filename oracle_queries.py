"""The registered queries as SQL over the given tables, for comparison by an independent engine."""

from __future__ import annotations

from paidup.config import NOTES, ORIGIN_LABELS, ORIGIN_DEFAULT, STAGE_LABELS
from paidup.operators.dunning import CLOSINGS, OPENINGS, SUBJECTS

CUT = "DATE '2001-08-01'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(column: str, entries: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in entries.items())
    return f"CASE {column} {whens} ELSE {default} END"


def _band(days: str) -> str:
    return (
        f"CASE WHEN {days} < 0 THEN 'AL_DIA' WHEN {days} <= 30 THEN '0-30' WHEN {days} <= 60 THEN '31-60' "
        f"WHEN {days} <= 90 THEN '61-90' WHEN {days} <= 120 THEN '91-120' ELSE '121+' END"
    )


def _fp(desc: str, amount: str, day: str) -> str:
    return f"left(sha1(upper(trim({desc})) || '|' || CAST({amount} AS VARCHAR) || '|' || strftime({day}, '%Y-%m-%d')), 16)"


_BAND_ORD = "list_position(['AL_DIA','0-30','31-60','61-90','91-120','121+'], aging_band)"
_ORIGIN = _case("match_method", ORIGIN_LABELS, _q(ORIGIN_DEFAULT))

# Derived tables; each entry may use the ones before it.
_TABLES = {
    "cl": """SELECT o_orderkey AS k, c_custkey AS ck, c_name AS client, upper(trim(c_name)) AS cn,
        o_orderstatus AS st, CAST((1 + floor(o_totalprice / 1000)) * 1000 AS DECIMAL(18,2)) AS amt
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "items": f"""SELECT k AS item_ord, client, cn AS client_norm, 'FV-' || k AS document,
        {CUT} - CAST(k % 170 - 20 AS INTEGER) - 30 AS posting_date, {CUT} - CAST(k % 170 - 20 AS INTEGER) AS due_date,
        amt AS original_amount, amt AS open_amount, CAST(k % 170 - 20 AS INTEGER) AS days_overdue,
        {_band("(k % 170 - 20)")} AS aging_band FROM cl WHERE st <> 'F'""",
    "nx": """SELECT k, ck, cn, amt, coalesce(lead(amt, 1) OVER w, 0) AS a1, coalesce(lead(amt, 2) OVER w, 0) AS a2,
        coalesce(lead(amt, 3) OVER w, 0) AS a3 FROM cl WHERE st <> 'F' WINDOW w AS (PARTITION BY ck ORDER BY k)""",
    "mv0": """SELECT k, CASE k % 12 WHEN 1 THEN 'PAGO INTERBANC ' || cn WHEN 2 THEN 'PAGO DE PROV ' || cn || ' REF FV-' || k
        WHEN 3 THEN 'PAGO DE PROV TERCERO ' || k WHEN 5 THEN 'TRANSFER ALFA ' || lpad(CAST(ck AS VARCHAR), 9, '0')
        WHEN 6 THEN 'ABONO GRUPO BETA ' || k WHEN 10 THEN 'CONSIGNACION ' || k WHEN 11 THEN 'CONSIGNACION ' || k
        ELSE 'PAGO DE PROV ' || cn END AS description,
        CAST(CASE k % 12 WHEN 1 THEN amt + a1 WHEN 2 THEN amt + 333 WHEN 4 THEN amt + 500 WHEN 7 THEN amt + 1
        WHEN 8 THEN amt + a1 + a2 WHEN 9 THEN amt + a1 + a2 + a3 ELSE amt END AS DECIMAL(18,2)) AS amount FROM nx
        UNION ALL
        SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'PAGO A PROVEEDOR ' || o_orderkey WHEN 1 THEN 'ABONO INTERESES AHORROS'
        WHEN 2 THEN 'IMPTO GOBIERNO 4X1000' WHEN 3 THEN 'DEBITO POR ABONO CARTERA' WHEN 4 THEN 'PAGO EMPLEADO NOMINA'
        ELSE 'COMISION MANEJO' END, CAST(CASE o_orderkey % 6 WHEN 1 THEN 5 WHEN 5 THEN 0 ELSE -1000 - o_orderkey % 1000 END
        AS DECIMAL(18,2)) FROM orders WHERE o_orderstatus = 'F'""",
    "mov": f"""SELECT *, CASE
        WHEN flow = 'ABONO' AND contains(description, 'PAGO DE PROV') THEN 'PAGO_CLIENTE'
        WHEN contains(description, 'INTERESES') OR contains(description, 'INTERES AHORROS') THEN 'INTERESES_BANCO'
        WHEN contains(description, 'GMF') OR contains(description, '4X1000') OR contains(description, 'IVA')
          OR contains(description, 'RETEFUENTE') OR contains(description, 'RETENCION') THEN 'IMPUESTO'
        WHEN contains(description, 'DEBITO POR ABONO') OR contains(description, 'REVERSION')
          OR contains(description, 'AJUSTE') THEN 'AJUSTE_CONTABLE'
        WHEN flow = 'CARGO' AND (contains(description, 'PAGO A PROV') OR contains(description, 'PAGO PROV')
          OR contains(description, 'TRANSF A PROV')) THEN 'EGRESO_PROVEEDOR'
        WHEN flow = 'CARGO' AND (contains(description, 'NOMINA') OR contains(description, 'PAGO EMPLEADO')) THEN 'EGRESO_NOMINA'
        WHEN flow = 'ABONO' THEN 'PAGO_CLIENTE' ELSE 'OTRO_EGRESO' END AS category
        FROM (SELECT k AS movement_ord, {CUT} - CAST(k % 30 AS INTEGER) AS value_date, amount, abs(amount) AS amount_abs,
        CASE WHEN amount > 0 THEN 'ABONO' WHEN amount < 0 THEN 'CARGO' ELSE 'NULO' END AS flow, description FROM mv0)""",
    "pay": f"""SELECT movement_ord AS payment_id, value_date, amount, description,
        {_fp("description", "amount", "value_date")} AS fingerprint FROM mov WHERE category = 'PAGO_CLIENTE'""",
    "al": """SELECT DISTINCT 'TRANSFER ALFA ' || lpad(CAST(ck AS VARCHAR), 9, '0') AS alias, cn AS real_client, ck AS alias_ord
        FROM cl WHERE st <> 'F' AND ck % 2 = 0 UNION ALL SELECT 'GRUPO BETA', 'CLIENTE SIN CARTERA', 1099511627776""",
    "dep": f"""SELECT k, cn, amt AS amount, 'CONSIGNACION ' || k AS description, {CUT} - CAST(k % 30 AS INTEGER) AS value_date,
        {_fp("('CONSIGNACION ' || k)", "amt", f"({CUT} - CAST(k % 30 AS INTEGER))")} AS fingerprint, k % 12 AS kind
        FROM cl WHERE st <> 'F' AND k % 12 IN (10, 11)""",
    "hist": f"""SELECT {CUT} - CAST((k // 24) % 3 AS INTEGER) AS run_day, fingerprint FROM dep WHERE kind = 11 AND (k // 12) % 2 = 0""",
    "d0": """SELECT *, (k // 12) % 8 AS what, (SELECT 'FV-' || min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F') AS smallest
        FROM dep WHERE kind = 10""",
    "decs": f"""SELECT CAST({CUT} AS TIMESTAMP) + to_minutes(CAST(k % 1000 AS INTEGER)) AS decided_at, fingerprint, amount, description,
        CASE WHEN what IN (0, 1, 2, 7) THEN 'APLICAR_FACTURA' WHEN what = 3 THEN 'PAGO_PARCIAL' WHEN what = 4 THEN 'PENDIENTE'
        WHEN what = 5 THEN 'NO_CORRESPONDE' ELSE 'CLIENTE_NUEVO' END AS action,
        CASE WHEN what IN (0, 7) THEN 'FV-' || k WHEN what = 1 THEN 'FV-X' || k WHEN what = 2 THEN smallest END AS assigned_document,
        cn AS assigned_client, 'ACTIVA' AS decision_state, k * 2 AS decision_ord FROM d0
        UNION ALL SELECT CAST({CUT} AS TIMESTAMP) + to_days(1), fingerprint, amount, description, 'REVERTIR', NULL, NULL,
        'REVERTIDA', k * 2 + 1 FROM d0 WHERE what = 7""",
    "lastd": "SELECT * FROM decs QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY decision_ord DESC) = 1",
    "act": "SELECT * FROM lastd WHERE upper(decision_state) = 'ACTIVA'",
    "conf": """SELECT assigned_document AS document, count(*) AS claims FROM act WHERE action = 'APLICAR_FACTURA'
        AND assigned_document IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "valid": """SELECT fingerprint, assigned_document AS document, assigned_document IN (SELECT document FROM items) AS still_open
        FROM act WHERE action = 'APLICAR_FACTURA'""",
    "ruled": f"""SELECT * FROM (SELECT a.fingerprint, CASE
        WHEN a.action = 'APLICAR_FACTURA' AND v.still_open AND c.document IS NOT NULL THEN 'manual_conflicto'
        WHEN a.action = 'APLICAR_FACTURA' AND v.still_open THEN 'manual_analista'
        WHEN a.action = 'PAGO_PARCIAL' THEN 'manual_parcial' WHEN a.action = 'PENDIENTE' THEN 'manual_pendiente'
        WHEN a.action = 'NO_CORRESPONDE' THEN 'manual_no_aplica' WHEN a.action = 'CLIENTE_NUEVO' THEN 'manual_cliente_nuevo'
        END AS match_method, CASE WHEN a.action <> 'NO_CORRESPONDE' THEN a.assigned_client END AS client,
        CASE WHEN a.action = 'APLICAR_FACTURA' THEN a.assigned_document ELSE '' END AS documents, a.decided_at
        FROM act a LEFT JOIN valid v ON a.fingerprint = v.fingerprint LEFT JOIN conf c ON c.document = a.assigned_document)
        WHERE match_method IS NOT NULL""",
    "ruling": f"""SELECT fingerprint, CASE match_method WHEN 'manual_conflicto' THEN 'AMBIGUO' WHEN 'manual_analista' THEN 'ASOCIADO'
        WHEN 'manual_pendiente' THEN 'PENDIENTE_ANALISTA' WHEN 'manual_no_aplica' THEN 'NO_APLICA' ELSE 'NO_IDENTIFICADO' END
        AS match_state, match_method, client, documents, CASE match_method
        WHEN 'manual_conflicto' THEN replace({_q(NOTES["manual_conflicto"])}, '{{document}}', documents)
        WHEN 'manual_analista' THEN replace({_q(NOTES["manual_analista"])}, '{{decided_at}}', strftime(decided_at, '%Y-%m-%d %H:%M:%S'))
        WHEN 'manual_parcial' THEN {_q(NOTES["manual_parcial"])} WHEN 'manual_pendiente' THEN {_q(NOTES["manual_pendiente"])}
        WHEN 'manual_no_aplica' THEN {_q(NOTES["manual_no_aplica"])} ELSE {_q(NOTES["manual_cliente_nuevo"])} END AS note FROM ruled""",
    "dir": "SELECT client_norm, min(item_ord) AS client_ord FROM items GROUP BY 1",
    "needles": """SELECT client_norm, client_ord, client_norm AS needle FROM dir UNION ALL
        SELECT client_norm, client_ord, w FROM (SELECT client_norm, client_ord, unnest(string_split(client_norm, ' ')) AS w FROM dir)
        WHERE length(w) > 3""",
    "txt": "SELECT DISTINCT description FROM pay",
    "by_alias": "SELECT description, arg_min(real_client, alias_ord) AS client FROM txt JOIN al ON contains(description, alias) GROUP BY 1",
    "by_name": "SELECT description, arg_min(client_norm, client_ord) AS client FROM txt JOIN needles ON contains(description, needle) GROUP BY 1",
    "named": """SELECT p.*, coalesce(a.client, n.client) AS client, CASE WHEN a.client IS NOT NULL THEN 'alias'
        WHEN n.client IS NOT NULL THEN 'directo' END AS client_method FROM pay p LEFT JOIN by_alias a USING (description)
        LEFT JOIN by_name n USING (description)""",
    "ask": "SELECT DISTINCT client AS client_norm, amount FROM named WHERE client IS NOT NULL",
    "exact": """SELECT client_norm, amount, count(*) AS n_exact, string_agg(document, ',' ORDER BY item_ord) AS docs
        FROM ask JOIN items USING (client_norm) WHERE abs(open_amount - amount) <= 1 GROUP BY 1, 2""",
    "few": "SELECT * FROM items WHERE client_norm IN (SELECT client_norm FROM items GROUP BY 1 HAVING count(*) <= 15)",
    "sums": """SELECT a.client_norm, 2 AS k, a.document || ',' || b.document AS documents, a.open_amount + b.open_amount AS total,
        a.item_ord AS o1, b.item_ord AS o2, 0 AS o3, 0 AS o4 FROM few a JOIN few b ON a.client_norm = b.client_norm AND a.item_ord < b.item_ord
        UNION ALL SELECT a.client_norm, 3, a.document || ',' || b.document || ',' || c.document, a.open_amount + b.open_amount + c.open_amount,
        a.item_ord, b.item_ord, c.item_ord, 0 FROM few a JOIN few b ON a.client_norm = b.client_norm AND a.item_ord < b.item_ord
        JOIN few c ON c.client_norm = b.client_norm AND b.item_ord < c.item_ord
        UNION ALL SELECT a.client_norm, 4, a.document || ',' || b.document || ',' || c.document || ',' || d.document,
        a.open_amount + b.open_amount + c.open_amount + d.open_amount, a.item_ord, b.item_ord, c.item_ord, d.item_ord
        FROM few a JOIN few b ON a.client_norm = b.client_norm AND a.item_ord < b.item_ord
        JOIN few c ON c.client_norm = b.client_norm AND b.item_ord < c.item_ord
        JOIN few d ON d.client_norm = c.client_norm AND c.item_ord < d.item_ord""",
    "sumhit": """SELECT client_norm, amount, count(*) AS n_sums, arg_min(documents, (k, o1, o2, o3, o4)) AS docs, arg_min(k, (k, o1, o2, o3, o4)) AS k
        FROM ask JOIN sums USING (client_norm) WHERE abs(total - amount) <= 1 GROUP BY 1, 2""",
    "quoted": """SELECT payment_id, count(*) AS n_quoted, string_agg(document, ',' ORDER BY item_ord) AS quoted
        FROM named JOIN items ON named.client = client_norm WHERE contains(description, document) GROUP BY 1""",
    "matches": f"""SELECT p.payment_id, p.value_date, p.amount, p.description, CASE WHEN h.fingerprint IS NOT NULL THEN NULL
        WHEN r.fingerprint IS NOT NULL THEN r.client ELSE p.client END AS client,
        CASE WHEN h.fingerprint IS NOT NULL THEN 'YA_PROCESADO' WHEN r.fingerprint IS NOT NULL THEN r.match_state
        WHEN p.client IS NULL THEN 'CLIENTE_DESCONOCIDO' WHEN c.client_norm IS NULL THEN 'NO_IDENTIFICADO'
        WHEN n_exact = 1 THEN 'ASOCIADO' WHEN n_exact > 1 THEN 'AMBIGUO' WHEN n_sums = 1 THEN 'ASOCIADO' WHEN n_sums > 1 THEN 'AMBIGUO'
        WHEN n_quoted > 0 THEN 'ASOCIADO' ELSE 'NO_IDENTIFICADO' END AS match_state,
        CASE WHEN h.fingerprint IS NOT NULL THEN 'historial' WHEN r.fingerprint IS NOT NULL THEN r.match_method
        WHEN p.client IS NULL OR c.client_norm IS NULL THEN 'ninguno'
        WHEN n_exact = 1 THEN 'exacto' WHEN n_exact > 1 THEN 'exacto_multiple' WHEN n_sums = 1 THEN 'acumulado'
        WHEN n_sums > 1 THEN 'acumulado_multiple' WHEN n_quoted > 0 THEN 'referencia' ELSE 'ninguno' END AS match_method,
        CASE WHEN h.fingerprint IS NOT NULL THEN 'historial' WHEN r.fingerprint IS NOT NULL THEN 'manual'
        ELSE coalesce(p.client_method, 'ninguno') END AS client_method,
        CASE WHEN h.fingerprint IS NOT NULL THEN '' WHEN r.fingerprint IS NOT NULL THEN r.documents
        WHEN p.client IS NULL OR c.client_norm IS NULL THEN '' ELSE coalesce(e.docs, s.docs, q.quoted, '') END AS documents,
        CASE WHEN h.fingerprint IS NOT NULL THEN {_q(NOTES["historial"])} WHEN r.fingerprint IS NOT NULL THEN r.note
        WHEN p.client IS NULL THEN {_q(NOTES["unknown_client"])} WHEN c.client_norm IS NULL THEN {_q(NOTES["no_open_items"])}
        WHEN n_exact = 1 THEN '' WHEN n_exact > 1 THEN replace({_q(NOTES["exacto_multiple"])}, '{{n}}', CAST(n_exact AS VARCHAR))
        WHEN n_sums = 1 THEN '' WHEN n_sums > 1 THEN replace({_q(NOTES["acumulado_multiple"])}, '{{n}}', CAST(n_sums AS VARCHAR))
        WHEN n_quoted > 0 THEN '' ELSE {_q(NOTES["nothing_matches"])} END AS note, p.fingerprint
        FROM named p LEFT JOIN (SELECT DISTINCT fingerprint FROM hist) h ON h.fingerprint = p.fingerprint
        LEFT JOIN ruling r ON r.fingerprint = p.fingerprint
        LEFT JOIN dir c ON c.client_norm = p.client
        LEFT JOIN exact e ON e.client_norm = p.client AND e.amount = p.amount
        LEFT JOIN sumhit s ON s.client_norm = p.client AND s.amount = p.amount
        LEFT JOIN quoted q ON q.payment_id = p.payment_id""",
    "m": """SELECT payment_id, value_date, amount, description, client, match_state, match_method, client_method, documents,
        CASE WHEN documents = '' THEN 0 ELSE length(documents) - length(replace(documents, ',', '')) + 1 END AS n_documents,
        note, fingerprint FROM matches""",
    "applied": """SELECT unnest(string_split(documents, ',')) AS document, client, payment_id, match_method, value_date
        FROM m WHERE match_state = 'ASOCIADO' AND documents <> ''""",
    "firstp": """SELECT document, payment_id, match_method, value_date AS payment_date FROM applied
        QUALIFY row_number() OVER (PARTITION BY document ORDER BY payment_id) = 1""",
    "base": f"""SELECT *, CASE WHEN is_paid THEN 'PAGADA' WHEN days_overdue > 0 THEN 'VENCIDA' ELSE 'AL_DIA' END AS invoice_state,
        CASE WHEN is_paid AND days_overdue <= 0 THEN 'RESUELTO' WHEN days_overdue > 60 THEN 'CRITICO' WHEN days_overdue > 30 THEN 'ALTO'
        WHEN days_overdue > 0 THEN 'MEDIO' ELSE 'BAJO' END AS priority, {_ORIGIN} AS origin
        FROM (SELECT i.*, f.payment_id, f.match_method, f.payment_date, f.payment_id IS NOT NULL AS is_paid
        FROM items i LEFT JOIN firstp f USING (document))""",
    "exc": f"""SELECT *, {_ORIGIN} AS origin FROM m
        WHERE match_state IN ('AMBIGUO', 'NO_IDENTIFICADO', 'CLIENTE_DESCONOCIDO', 'PENDIENTE_ANALISTA')""",
    "lab": """SELECT document, document || '  ·  $' || format('{:,}', CAST(open_amount AS BIGINT)) || '  ·  vence '
        || strftime(due_date, '%Y-%m-%d') AS label, upper(client_norm) AS client_key, is_paid FROM base""",
    "worst": f"""SELECT client, ['AL_DIA','0-30','31-60','61-90','91-120','121+'][max({_BAND_ORD})] AS worst_band,
        count(*) AS invoices, sum(open_amount) AS total FROM base WHERE NOT is_paid GROUP BY 1""",
    "stages": f"""SELECT *, {_case("stage", STAGE_LABELS)} AS stage_label FROM (SELECT *, CASE worst_band WHEN 'AL_DIA' THEN 'SEMANA_0'
        WHEN '61-90' THEN 'SEMANA_4' WHEN '91-120' THEN 'SEMANA_5' WHEN '121+' THEN 'SEMANA_6' ELSE 'SEMANA_1_3' END AS stage FROM worst)""",
    "sets": """SELECT client_norm, CAST(amount * 100 AS BIGINT) AS cents, item_ord, document FROM
        (SELECT DISTINCT client AS client_norm, amount FROM m WHERE match_method = 'exacto_multiple') JOIN items USING (client_norm)
        WHERE abs(open_amount - amount) <= 1""",
    "sitems": f"""SELECT o_orderkey AS item_ord, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS client, upper(c_mktsegment) AS client_norm,
        'FV-' || (o_orderkey // 8) AS document, CAST((1 + floor(o_totalprice / 100000)) * 100000 AS DECIMAL(18,2)) AS open_amount,
        {CUT} - CAST(o_orderkey % 170 - 20 AS INTEGER) AS due_date, CAST(o_orderkey % 170 - 20 AS INTEGER) AS days_overdue,
        {_band("(o_orderkey % 170 - 20)")} AS aging_band FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""",
    "spay": f"""SELECT *, {_fp("description", "amount", "value_date")} AS fingerprint FROM (SELECT item_ord AS payment_id, client_norm,
        open_amount + CASE item_ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 333 END AS amount, {CUT} - CAST(item_ord % 30 AS INTEGER) AS value_date,
        'PAGO DE PROV ' || client_norm || CASE WHEN item_ord % 3 = 0 THEN '' ELSE ' REF ' || document END AS description FROM sitems)""",
    "sexact": """SELECT client_norm, amount, count(*) AS n_exact, min(document) AS document FROM (SELECT DISTINCT client_norm, amount FROM spay)
        JOIN sitems USING (client_norm) WHERE abs(open_amount - amount) <= 1 GROUP BY 1, 2""",
    "squoted": """SELECT payment_id, CAST(sum(n) AS BIGINT) AS n_quoted, string_agg(document, ',' ORDER BY first) AS quoted FROM spay p JOIN
        (SELECT client_norm, document, count(*) AS n, min(item_ord) AS first FROM sitems GROUP BY 1, 2) i
        ON p.client_norm = i.client_norm AND contains(description, document) GROUP BY 1""",
    "sm": """SELECT p.*, n_exact, CASE WHEN n_exact > 1 THEN 'AMBIGUO' WHEN n_exact = 1 OR n_quoted > 0 THEN 'ASOCIADO' ELSE 'NO_IDENTIFICADO' END AS match_state,
        CASE WHEN n_exact > 1 THEN 'exacto_multiple' WHEN n_exact = 1 THEN 'exacto' WHEN n_quoted > 0 THEN 'referencia' ELSE 'ninguno' END AS match_method,
        CASE WHEN n_exact > 1 THEN '' WHEN n_exact = 1 THEN document ELSE coalesce(quoted, '') END AS documents,
        coalesce(n_exact, n_quoted, 0) AS n_documents, CASE WHEN n_exact > 1 THEN CAST(amount * 100 AS BIGINT) END AS candidate_cents
        FROM spay p LEFT JOIN sexact USING (client_norm, amount) LEFT JOIN squoted USING (payment_id)""",
    "ssets": """SELECT client_norm, candidate_cents AS cents, item_ord, document FROM
        (SELECT DISTINCT client_norm, amount, candidate_cents FROM sm WHERE candidate_cents IS NOT NULL) JOIN sitems USING (client_norm)
        WHERE abs(open_amount - amount) <= 1""",
    "sstages": f"""SELECT *, CASE worst_band WHEN 'AL_DIA' THEN 'SEMANA_0' WHEN '61-90' THEN 'SEMANA_4' WHEN '91-120' THEN 'SEMANA_5'
        WHEN '121+' THEN 'SEMANA_6' ELSE 'SEMANA_1_3' END AS stage FROM (SELECT client,
        ['AL_DIA','0-30','31-60','61-90','91-120','121+'][max({_BAND_ORD})] AS worst_band, count(*) AS invoices, sum(open_amount) AS total
        FROM sitems GROUP BY 1)""",
    "nat": """SELECT o_orderkey AS k, n_name, c_mktsegment, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey""",
    "cm": """SELECT upper(c_mktsegment || ' ' || n_name || ' SAS') AS client_norm, min(c_custkey) AS client_ord
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "cmn": """SELECT client_norm, client_ord, client_norm AS needle FROM cm UNION ALL SELECT * FROM
        (SELECT client_norm, client_ord, unnest(string_split(client_norm, ' ')) AS w FROM cm) WHERE length(w) > 3""",
    "tm": """SELECT DISTINCT unnest(['PAGO ' || n_name || ' ' || k, 'PAGO ' || c_mktsegment || ' ' || k]) AS description FROM nat""",
    "sheet": f"""SELECT k AS item_ord, CASE WHEN k % 25 <> 24 THEN client END AS client,
        CASE WHEN k % 2 = 0 THEN k || '' ELSE k || '.05' END AS document, CASE WHEN k % 2 = 0 THEN k || '.0' ELSE k || '.05' END AS raw_document,
        {CUT} - CAST(k % 170 - 20 AS INTEGER) - 30 AS posting_date,
        CASE WHEN k % 40 <> 39 THEN {CUT} - CAST(k % 170 - 20 AS INTEGER) END AS due_date, amt,
        CASE WHEN k % 35 NOT IN (33, 34) THEN amt END AS open_amount, CASE WHEN k % 40 <> 39 THEN CAST(k % 170 - 20 AS INTEGER) END AS days_overdue
        FROM cl WHERE st <> 'F'""",
}


def _deps(sql: str) -> list[str]:
    import re

    words = set(re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z_0-9]+)", sql))
    need: set[str] = set()
    todo = [t for t in words if t in _TABLES]
    while todo:
        t = todo.pop()
        if t not in need:
            need.add(t)
            todo += [d for d in re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z_0-9]+)", _TABLES[t]) if d in _TABLES]
    return [t for t in _TABLES if t in need]


def _full(sql: str) -> str:
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_TABLES[name]})" for name in _deps(sql))
    return f"WITH {ctes}\n{sql}" if ctes else sql


def _counts(column: str, table: str) -> str:
    return f"SELECT {column}, count(*) AS rows FROM {table} GROUP BY 1"


_M = (
    "payment_id, value_date, CAST(amount AS DOUBLE) AS amount, description, client, match_state, match_method, client_method, "
    "documents, n_documents, note, fingerprint"
)
_BASE = (
    "item_ord, client, client_norm, document, posting_date, due_date, CAST(original_amount AS DOUBLE) AS original_amount, "
    "CAST(open_amount AS DOUBLE) AS open_amount, days_overdue, aging_band, payment_id, match_method, payment_date, is_paid, "
    "invoice_state, priority, origin"
)
_DETAIL = (
    "client, document, due_date, days_overdue, CAST(open_amount AS DOUBLE) AS open_amount, aging_band, invoice_state, priority, origin"
)
_DIST = """SELECT CAST(band_ord - 1 AS INTEGER) AS band_ord, b.aging_band, count(i.document) AS invoices,
    CAST(coalesce(sum(open_amount), 0) AS DOUBLE) AS balance FROM (SELECT unnest(generate_series(1, 6)) AS band_ord,
    unnest(['AL_DIA','0-30','31-60','61-90','91-120','121+']) AS aging_band) b LEFT JOIN {table} i USING (aging_band) GROUP BY 1, 2"""
_SHEET = """SELECT item_ord, client, upper(client) AS client_norm, {document} AS document, posting_date, due_date,
    CAST(amt AS DOUBLE) AS original_amount, CAST(open_amount AS DOUBLE) AS open_amount, days_overdue, {band} AS aging_band
    FROM sheet WHERE open_amount > 0 AND client IS NOT NULL AND {more}"""
# The sheet with its rows counted from zero.
_POS = "FROM (SELECT * REPLACE (row_number() OVER (ORDER BY item_ord) - 1 AS item_ord), item_ord AS k FROM sheet)"
_LINE = (
    "'| ' || document || ' | ' || strftime(due_date, '%Y-%m-%d') || ' | ' || days_overdue || ' | $' "
    "|| format('{:,}', CAST(open_amount AS BIGINT)) || ' |'"
)
def _text(templates: dict[str, str]) -> str:
    return f"replace(replace({_case('stage', templates)}, '{{deadline}}', '08 de agosto de 2001'), '{{client}}', client)"


_CLOSING = f"""'| **TOTAL** |  |  | **$' || format('{{:,}}', CAST(total AS BIGINT)) || '** |' || {_text(CLOSINGS)}"""
_POS_OF_LINE = "row_number() OVER (PARTITION BY client ORDER BY days_overdue DESC, document, item_ord)"

_SQL = {
    "movements_typed": """SELECT movement_ord, CASE WHEN movement_ord % 50 <> 49 THEN value_date END AS value_date,
        CAST(a AS DOUBLE) AS amount, CAST(abs(a) AS DOUBLE) AS amount_abs, CASE WHEN a > 0 THEN 'ABONO' WHEN a < 0 THEN 'CARGO' ELSE 'NULO' END AS flow,
        CASE WHEN movement_ord % 30 <> 29 THEN CAST(movement_ord % 1000 AS INTEGER) END AS bank_code, description
        FROM (SELECT *, CASE WHEN movement_ord % 70 <> 69 THEN amount END AS a FROM mov)""",
    "day_first_dates": "SELECT item_ord, due_date FROM sheet",
    "weekly_items": _SHEET.format(document="document", band=_band("days_overdue"), more="item_ord >= 3"),
    "erp_items": _SHEET.format(document="raw_document", band=_band("days_overdue"), more="item_ord % 9 <> 8"),
    "movement_flow": _counts("flow", "mov"),
    "movement_categories": "SELECT movement_ord, flow, category FROM mov",
    "category_counts": _counts("category", "mov"),
    "date_filter": "SELECT movement_ord, value_date FROM mov WHERE value_date BETWEEN DATE '2001-07-10' AND DATE '2001-07-25'",
    "date_filter_count": """SELECT count(*) FILTER (value_date BETWEEN DATE '2001-07-10' AND DATE '2001-07-25') AS kept,
        count(*) FILTER (value_date NOT BETWEEN DATE '2001-07-10' AND DATE '2001-07-25') AS discarded,
        count(*) FILTER (value_date IS NULL) AS without_date FROM mov""",
    "movement_totals": """SELECT count(*) AS movements, min(value_date) AS first_date, max(value_date) AS last_date,
        count(*) FILTER (flow = 'ABONO') AS credits, count(*) FILTER (flow = 'CARGO') AS debits FROM mov""",
    "open_items_aged": """SELECT item_ord, client, client_norm, document, due_date, CAST(open_amount AS DOUBLE) AS open_amount,
        days_overdue, aging_band FROM items""",
    "portfolio": "SELECT count(*) AS invoices, count(DISTINCT client_norm) AS clients, CAST(sum(open_amount) AS DOUBLE) AS open_balance FROM items",
    "aging_distribution": _DIST.format(table="items"),
    "band_counts": _counts("aging_band", "items"),
    "fingerprints": f"SELECT movement_ord, {_fp('description', 'amount', 'value_date')} AS fingerprint FROM mov",
    "history_semi": "SELECT payment_id, fingerprint FROM pay WHERE fingerprint IN (SELECT fingerprint FROM hist)",
    "history_anti": "SELECT payment_id, fingerprint FROM pay WHERE fingerprint NOT IN (SELECT fingerprint FROM hist)",
    "decisions_last": "SELECT fingerprint, action, decision_state, decision_ord FROM lastd",
    "decisions_last_active": "SELECT fingerprint, action, assigned_document, assigned_client FROM act",
    "decision_conflicts": "SELECT document, claims FROM conf",
    "decision_validity": "SELECT fingerprint, document, still_open FROM valid",
    "missing_documents": "SELECT DISTINCT document FROM valid WHERE NOT still_open",
    "decision_outcomes": "SELECT fingerprint, match_state, match_method, client, documents, note FROM ruling",
    "decision_totals": "SELECT (SELECT count(*) FROM decs) AS decisions, (SELECT count(*) FROM act) AS active_decisions",
    "decisions_audit": """SELECT fingerprint, action, concat_ws(' · ', '**Pago:** ' || description,
        '**Monto:** $' || format('{:,}', CAST(amount AS BIGINT)), '**Cliente:** ' || assigned_client, '**Factura:** ' || assigned_document)
        AS details FROM act WHERE action IN ('APLICAR_FACTURA', 'PAGO_PARCIAL', 'PENDIENTE')""",
    "reverts": """SELECT p.fingerprint, a.fingerprint IS NOT NULL AS accepted, a.fingerprint IS NOT NULL AND h.fingerprint IS NULL AS reopens,
        'Reversión de decisión previa (' || a.action || ').' AS comment FROM (SELECT DISTINCT fingerprint FROM pay WHERE starts_with(description, 'CONSIGNACION')) p
        LEFT JOIN act a USING (fingerprint) LEFT JOIN (SELECT DISTINCT fingerprint FROM hist) h USING (fingerprint)""",
    "aliases_catalogue": "SELECT alias, real_client, alias_ord FROM al",
    "aliases_new": """SELECT DISTINCT description AS alias, 'NUEVO CLIENTE' AS real_client FROM pay
        WHERE starts_with(description, 'TRANSFER ALFA') AND description NOT IN (SELECT alias FROM al)""",
    "omitted_count": "SELECT count(*) FILTER (run_day <> (SELECT max(run_day) FROM hist)) AS omitted FROM hist",
    "run_times": "SELECT strftime(run_day, '%Y-%m-%d') AS run_day, count(*) AS rows FROM hist GROUP BY 1",
    "client_directory": "SELECT client_norm, client_ord FROM cm",
    "client_identify_shared": """SELECT description, arg_min(client_norm, client_ord) AS client FROM tm
        JOIN cmn ON contains(description, needle) GROUP BY 1""",
    "alias_identify": "SELECT payment_id, client FROM named WHERE client_method = 'alias'",
    "client_identify": "SELECT payment_id, client FROM named WHERE client_method = 'directo'",
    "exact_hits": "SELECT client_norm, CAST(amount * 100 AS BIGINT) AS cents, n_exact, docs AS exact FROM exact",
    "combos": "SELECT client_norm, CAST(k AS BIGINT) AS k, documents, CAST(total * 100 AS BIGINT) AS cents FROM sums",
    "accumulated_hits": "SELECT client_norm, CAST(amount * 100 AS BIGINT) AS cents, n_sums, docs AS first_sum FROM sumhit",
    "reference_hits": "SELECT payment_id, n_quoted, quoted FROM quoted",
    "reference_hits_of_many": "SELECT payment_id, n_quoted, quoted FROM squoted",
    "match_cascade": f"SELECT {_M} FROM m",
    "match_large_clients": """SELECT payment_id, CAST(amount AS DOUBLE) AS amount, description, client_norm AS client, match_state, match_method,
        'directo' AS client_method, documents, n_documents, candidate_cents FROM sm""",
    "candidate_sets": "SELECT client_norm, cents, item_ord, document FROM ssets",
    "match_state_counts": "SELECT match_state, match_method, client_method, count(*) AS rows FROM m GROUP BY 1, 2, 3",
    "match_totals": """SELECT count(*) FILTER (client_method = 'manual') AS decisions_applied,
        count(*) FILTER (match_state = 'YA_PROCESADO') AS already_processed FROM m""",
    "payment_first_per_document": "SELECT document, payment_id, match_method, payment_date FROM firstp",
    "consolidated": f"SELECT {_BASE} FROM base",
    "consolidated_by_client": """SELECT item_ord, payment_id, payment_id IS NOT NULL AS is_paid, CASE WHEN payment_id IS NOT NULL THEN 'PAGADA'
        WHEN days_overdue > 0 THEN 'VENCIDA' ELSE 'AL_DIA' END AS invoice_state FROM items LEFT JOIN
        (SELECT client AS client_norm, document, min(payment_id) AS payment_id FROM applied GROUP BY 1, 2) USING (client_norm, document)""",
    "priority_counts": _counts("priority", "base"),
    "exceptions": f"SELECT {_M}, origin FROM exc",
    "exception_counts": _counts("match_state", "exc"),
    "history_new": """SELECT fingerprint, value_date AS payment_date, CAST(amount AS DOUBLE) AS amount, description,
        match_state AS initial_state, match_method, documents FROM m WHERE match_state = 'ASOCIADO'
        AND fingerprint NOT IN (SELECT fingerprint FROM hist)""",
    "history_totals": """SELECT count(*) FILTER (fingerprint NOT IN (SELECT fingerprint FROM hist)) AS new_payments,
        count(*) FILTER (fingerprint IN (SELECT fingerprint FROM hist)) AS already_there FROM m WHERE match_state = 'ASOCIADO'""",
    "full_run": """SELECT invoice_state, priority, origin, count(*) AS invoices, CAST(sum(open_amount) AS DOUBLE) AS balance,
        min(pos) AS first_payment FROM base LEFT JOIN (SELECT payment_id, row_number() OVER (ORDER BY payment_id) - 1 AS pos FROM pay)
        USING (payment_id) GROUP BY 1, 2, 3""",
    "kpis": """SELECT CAST(coalesce(sum(open_amount) FILTER (NOT is_paid), 0) AS DOUBLE) AS open_balance, count(*) FILTER (NOT is_paid) AS open_invoices,
        CAST(coalesce(sum(open_amount) FILTER (NOT is_paid AND priority = 'CRITICO'), 0) AS DOUBLE) AS critical_balance,
        count(*) FILTER (NOT is_paid AND priority = 'CRITICO') AS critical_invoices, count(*) FILTER (is_paid) AS invoices_with_payment FROM base""",
    "critical_totals": """SELECT count(*) AS critical_invoices, CAST(coalesce(sum(open_amount), 0) AS DOUBLE) AS critical_balance
        FROM base WHERE priority = 'CRITICO'""",
    "aging_distribution_unpaid": _DIST.format(table="(SELECT * FROM base WHERE NOT is_paid)"),
    "open_clients": """SELECT client, invoices, CAST(total AS DOUBLE) AS open_balance, max_days_overdue, worst_band FROM worst JOIN
        (SELECT client, max(days_overdue) AS max_days_overdue FROM base WHERE NOT is_paid GROUP BY 1) USING (client)""",
    "critical_top10": """SELECT client, document, CAST(open_amount AS DOUBLE) AS open_amount, days_overdue FROM base WHERE priority = 'CRITICO'
        ORDER BY days_overdue DESC, document LIMIT 10""",
    "detail_sorted": f"SELECT {_DETAIL} FROM base",
    "detail_filtered": f"SELECT {_DETAIL} FROM base WHERE priority = 'ALTO' AND invoice_state = 'VENCIDA' AND aging_band = '31-60'",
    "option_lists": f"""SELECT DISTINCT 'client' AS list, 0 AS ord, client AS value FROM base
        UNION ALL SELECT DISTINCT 'priority', CAST(list_position(['CRITICO','ALTO','MEDIO','BAJO','RESUELTO'], priority) - 1 AS INTEGER), priority FROM base
        UNION ALL SELECT DISTINCT 'invoice_state', 0, invoice_state FROM base
        UNION ALL SELECT DISTINCT 'aging_band', CAST({_BAND_ORD} - 1 AS INTEGER), aging_band FROM base""",
    "origin_options": "SELECT DISTINCT origin FROM exc",
    "exceptions_worklist": """SELECT payment_id, fingerprint, match_state, origin, CASE WHEN starts_with(origin, 'Manual')
        THEN strftime(t, '%Y-%m-%d') END AS decided_on FROM exc LEFT JOIN
        (SELECT fingerprint, max(decided_at) AS t FROM decs GROUP BY 1) USING (fingerprint)""",
    "exceptions_by_origin": """SELECT payment_id, origin FROM exc
        WHERE origin IN ('Manual (pendiente)', 'Manual (pago parcial)', 'Conflicto manual')""",
    "candidate_labels": """SELECT payment_id, document, coalesce(label, document) AS label FROM
        (SELECT payment_id, unnest(string_split(documents, ',')) AS document FROM m WHERE match_state = 'AMBIGUO') LEFT JOIN lab USING (document)""",
    "client_choices": "SELECT client_key, document, label FROM lab WHERE NOT is_paid",
    "decision_options": """SELECT payment_id, fingerprint, match_state, 'APLICAR_FACTURA' AS action,
        unnest(string_split(documents, ',')) AS document, client, CAST(NULL AS BIGINT) AS cents, CAST(NULL AS VARCHAR) AS alias_source
        FROM exc WHERE match_state = 'AMBIGUO' AND match_method <> 'exacto_multiple'
        UNION ALL SELECT DISTINCT NULL, NULL, 'AMBIGUO', 'APLICAR_FACTURA', document, client_norm, cents, NULL FROM sets
        UNION ALL SELECT NULL, NULL, 'NO_IDENTIFICADO', 'APLICAR_FACTURA', document, client_key, NULL, NULL FROM lab WHERE NOT is_paid
        AND client_key IN (SELECT upper(client) FROM exc WHERE match_state = 'NO_IDENTIFICADO')
        UNION ALL SELECT payment_id, fingerprint, match_state, unnest(['PENDIENTE', 'NO_CORRESPONDE']), NULL, NULL, NULL, NULL FROM exc WHERE match_state = 'AMBIGUO'
        UNION ALL SELECT payment_id, fingerprint, match_state, unnest(['PAGO_PARCIAL', 'PENDIENTE', 'NO_CORRESPONDE']), NULL, client, NULL, NULL
        FROM exc WHERE match_state = 'NO_IDENTIFICADO'
        UNION ALL SELECT payment_id, fingerprint, match_state, a, NULL, NULL, NULL, CASE WHEN a = 'AGREGAR_ALIAS' THEN upper(trim(description)) END FROM
        (SELECT *, unnest(['AGREGAR_ALIAS', 'CLIENTE_NUEVO', 'NO_CORRESPONDE']) AS a FROM exc WHERE match_state = 'CLIENTE_DESCONOCIDO')""",
    "decision_options_large_clients": """SELECT DISTINCT CAST(NULL AS BIGINT) AS payment_id, CAST(NULL AS VARCHAR) AS fingerprint, 'AMBIGUO' AS match_state,
        'APLICAR_FACTURA' AS action, document, client_norm AS client, cents, CAST(NULL AS VARCHAR) AS alias_source FROM ssets
        UNION ALL SELECT payment_id, fingerprint, match_state, unnest(['PENDIENTE', 'NO_CORRESPONDE']), NULL, NULL, NULL, NULL FROM sm
        WHERE match_state = 'AMBIGUO'""",
    "decisions_allowed": """SELECT payment_id, 'APLICAR_FACTURA' AS action, own AS document FROM (SELECT *, 'FV-' || payment_id AS own FROM exc) e
        WHERE CASE WHEN match_method = 'exacto_multiple' THEN EXISTS (SELECT 1 FROM sets WHERE client_norm = e.client AND cents = e.amount * 100 AND document = own)
        WHEN match_state = 'AMBIGUO' THEN list_contains(string_split(documents, ','), own)
        WHEN match_state = 'NO_IDENTIFICADO' THEN EXISTS (SELECT 1 FROM lab WHERE NOT is_paid AND client_key = upper(e.client) AND document = own) END""",
    "worst_band": "SELECT client, worst_band FROM worst",
    "dunning_stage": "SELECT client, worst_band, stage, stage_label FROM stages",
    "dunning_letters": f"""SELECT client, invoices, CAST(total AS DOUBLE) AS total, worst_band, stage, stage_label,
        replace({_case("stage", SUBJECTS)}, '{{client}}', client) AS subject, {_text(OPENINGS)} || chr(10) || lines || chr(10) || {_CLOSING} AS body
        FROM stages JOIN (SELECT client, string_agg({_LINE}, chr(10) ORDER BY days_overdue DESC, document, item_ord) AS lines FROM base
        WHERE NOT is_paid GROUP BY 1) USING (client)""",
    "dunning_lines": f"SELECT client, {_POS_OF_LINE} AS pos, {_LINE} AS line FROM base WHERE NOT is_paid",
    "letters_large_clients": f"""SELECT client, CAST(0 AS BIGINT) AS pos, {_text(OPENINGS)} AS text FROM sstages
        UNION ALL SELECT client, {_POS_OF_LINE}, {_LINE} FROM sitems UNION ALL SELECT client, invoices + 1, {_CLOSING} FROM sstages""",
    "statement_scan": """SELECT pos AS movement_ord, '001' AS account, value_date, CAST(a AS DOUBLE) AS amount, CAST(abs(a) AS DOUBLE) AS amount_abs,
        CASE WHEN a > 0 THEN 'ABONO' WHEN a < 0 THEN 'CARGO' ELSE 'NULO' END AS flow,
        CASE WHEN movement_ord % 30 <> 29 THEN CAST(movement_ord % 1000 AS INTEGER) END AS bank_code, description
        FROM (SELECT *, CASE WHEN movement_ord % 70 <> 69 THEN amount END AS a, row_number() OVER (ORDER BY movement_ord) - 1 AS pos FROM mov)
        WHERE movement_ord % 50 <> 49 AND value_date BETWEEN DATE '2001-07-10' AND DATE '2001-07-25'""",
    "rejected_statement_lines": """SELECT pos AS movement_ord, CASE WHEN movement_ord % 40 = 39 THEN '001,short,' || movement_ord ELSE
        '001,,,' || strftime(value_date, '%Y%m%d') || ',,' || amount || ',1,' || movement_ord || ',0,,more' END AS line
        FROM (SELECT *, row_number() OVER (ORDER BY movement_ord) - 1 AS pos FROM mov)
        WHERE movement_ord % 40 = 39 OR movement_ord % 60 = 58""",
    "erp_scan": _SHEET.format(document="raw_document", band=_band("days_overdue"), more="k % 9 <> 8").replace("FROM sheet", _POS),
    "weekly_scan": _SHEET.format(document="document", band=_band("days_overdue"), more="true").replace("FROM sheet", _POS.replace("- 1", "+ 2")),
    "decision_ledger": "SELECT fingerprint, action, assigned_document, assigned_client FROM act",
    "alias_ledger": "SELECT alias, real_client FROM al",
    "history_ledger": """SELECT run_day, count(*) AS rows FROM (SELECT strftime(run_day, '%Y-%m-%d') AS run_day FROM hist UNION ALL
        SELECT '2001-08-02' FROM m WHERE match_state = 'ASOCIADO' AND fingerprint NOT IN (SELECT fingerprint FROM hist)) GROUP BY 1""",
    "exceptions_exchange": """SELECT payment_id, value_date, CAST(amount AS DOUBLE) AS amount, match_method, documents, n_documents, origin FROM exc""",
    "detail_export": f"SELECT {_DETAIL} FROM base WHERE priority = 'CRITICO' AND invoice_state = 'VENCIDA'",
    "alias_file": "SELECT alias, real_client, row_number() OVER (ORDER BY alias_ord) - 1 AS alias_ord FROM al",
    "decision_file": """SELECT decided_at, fingerprint, CAST(decision_ord // 2 AS BIGINT) AS origin_payment_id, CAST(amount AS DOUBLE) AS amount,
        action, assigned_document, 'ACTIVA' AS decision_state FROM lastd""",
    "last_decision": """SELECT fingerprint, action, assigned_client, decision_state, decision_ord FROM lastd
        WHERE fingerprint = (SELECT min(fingerprint) FROM decs)""",
    "run_time_scan": "SELECT strftime(run_day, '%Y-%m-%d') AS run_day, count(*) AS rows FROM hist GROUP BY 1",
    "consolidated_reload": f"SELECT {_BASE} FROM base",
    "run_from_files": """SELECT match_state AS first_state, match_method AS first_method,
        CASE WHEN match_state = 'ASOCIADO' THEN 'YA_PROCESADO' ELSE match_state END AS second_state,
        CASE WHEN match_state = 'ASOCIADO' THEN 'historial' ELSE match_method END AS second_method, count(*) AS payments
        FROM m GROUP BY 1, 2, 3, 4""",
    "learning_loop": """SELECT first_state, second_state, match_method, client_method, count(*) AS payments FROM (SELECT first_state,
        CASE WHEN first_state = 'ASOCIADO' THEN 'YA_PROCESADO' WHEN r.fingerprint IS NOT NULL THEN r.match_state WHEN n_equal = 1 THEN 'ASOCIADO'
        WHEN n_equal > 1 THEN 'AMBIGUO' ELSE first_state END AS second_state,
        CASE WHEN first_state = 'ASOCIADO' THEN 'historial' WHEN r.fingerprint IS NOT NULL THEN r.match_method WHEN n_equal = 1 THEN 'exacto'
        WHEN n_equal > 1 THEN 'exacto_multiple' WHEN deposit THEN 'ninguno' ELSE f.match_method END AS match_method,
        CASE WHEN first_state = 'ASOCIADO' THEN 'historial' WHEN r.fingerprint IS NOT NULL THEN 'manual' WHEN n_equal > 0 THEN 'alias'
        WHEN deposit THEN 'ninguno' ELSE client_method END AS client_method
        FROM (SELECT *, description LIKE 'CONSIGNACION %' AS deposit, CASE WHEN description LIKE 'CONSIGNACION %' THEN 'CLIENTE_DESCONOCIDO'
        ELSE match_state END AS first_state, CASE WHEN match_state = 'CLIENTE_DESCONOCIDO' AND description LIKE 'TRANSFER ALFA %'
        THEN 'CUSTOMER#' || right(description, 9) END AS taught FROM m) f
        LEFT JOIN ruling r ON r.fingerprint = f.fingerprint
        LEFT JOIN (SELECT client_norm, open_amount, count(*) AS n_equal FROM items GROUP BY 1, 2) i
        ON i.client_norm = taught AND i.open_amount = f.amount) GROUP BY 1, 2, 3, 4""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _full(sql) for name, sql in _SQL.items()}
