"""Small tables for tests, and the cascade as a plain loop to compare with."""

from __future__ import annotations

import datetime as dt
import hashlib
from decimal import Decimal
from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from paidup.operators.aging import with_aging
from paidup.operators.classify import flow_of
from paidup.schemas import ALIASES, DECISIONS, HISTORY

DAY = dt.date(2026, 4, 15)
CUTOFF = dt.date(2026, 4, 16)


def movements(spark, rows, day=DAY):
    """rows: (amount, description) or (amount, description, date)."""
    data = [
        (i, r[2] if len(r) > 2 else day, Decimal(str(r[0])) if r[0] is not None else None, r[1]) for i, r in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data, "movement_ord long, value_date date, amount decimal(18,2), description string"
    )
    return df.withColumn("flow", flow_of(F.col("amount")))


def items(spark, rows, cutoff=CUTOFF):
    """rows: (client, document, amount, days overdue or None)."""
    data = [
        (i, c, c.upper(), d, Decimal(str(a)), cutoff - dt.timedelta(days=n) if n is not None else None)
        for i, (c, d, a, n) in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data, "item_ord long, client string, client_norm string, document string, open_amount decimal(18,2), due_date date"
    )
    return with_aging(
        df.withColumn("posting_date", F.date_sub("due_date", 30)).withColumn("original_amount", F.col("open_amount")), cutoff
    )


def aliases(spark, rows=()):
    data = [(a, c, "", i) for i, (a, c) in enumerate(rows)]
    return spark.createDataFrame(data, ALIASES)


def decisions(spark, rows=()):
    """rows: dicts of decision columns, in append order."""
    names = DECISIONS.fieldNames()
    data = [tuple([r.get(n) for n in names] + [i]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, T.StructType([*DECISIONS.fields, T.StructField("decision_ord", T.LongType())]))


def history(spark, fingerprints=()):
    data = [(dt.datetime(2026, 4, 1), f, None, None, None, "ASOCIADO", "exacto", []) for f in fingerprints]
    return spark.createDataFrame(data, HISTORY)


def fingerprint(description, amount, day=DAY):
    text = f"{(description or '').strip().upper()}|{Decimal(str(amount)):.2f}|{day.isoformat()}"
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def plain_cascade(payments, receivables, alias_rows, decision_rows, seen):
    """One payment at a time: list of (state, method, client_method, client, documents)."""
    alias_map = {}
    for a, c in alias_rows:
        alias_map[a.strip().upper()] = c.strip().upper()
    clients = list(dict.fromkeys(c.upper() for c, _, _, _ in receivables))
    by_client = {}
    for c, d, a, _ in receivables:
        by_client.setdefault(c.upper(), []).append((d, Decimal(str(a))))
    documents = {d.strip() for _, d, _, _ in receivables}
    last = {}
    for d in decision_rows:
        last[d["fingerprint"]] = d
    active = {k: d for k, d in last.items() if (d.get("decision_state") or "ACTIVA").upper() == "ACTIVA"}
    claims = {}
    for d in active.values():
        if d["action"] == "APLICAR_FACTURA" and d.get("assigned_document"):
            claims[d["assigned_document"]] = claims.get(d["assigned_document"], 0) + 1
    out = []
    for amount, text, *rest in payments:
        text = text or ""
        amount = Decimal(str(amount))
        fp = fingerprint(text, amount, rest[0] if rest else DAY)
        if fp in seen:
            out.append(("YA_PROCESADO", "historial", "historial", None, []))
            continue
        d = active.get(fp)
        if d is not None:
            action, doc, client = d["action"], d.get("assigned_document"), d.get("assigned_client")
            if action == "APLICAR_FACTURA" and doc in documents:
                if claims[doc] > 1:
                    out.append(("AMBIGUO", "manual_conflicto", "manual", client, [doc]))
                else:
                    out.append(("ASOCIADO", "manual_analista", "manual", client, [doc]))
                continue
            fixed = {
                "PAGO_PARCIAL": ("NO_IDENTIFICADO", "manual_parcial"),
                "PENDIENTE": ("PENDIENTE_ANALISTA", "manual_pendiente"),
                "NO_CORRESPONDE": ("NO_APLICA", "manual_no_aplica"),
                "CLIENTE_NUEVO": ("NO_IDENTIFICADO", "manual_cliente_nuevo"),
            }
            if action in fixed:
                state, method = fixed[action]
                out.append((state, method, "manual", None if action == "NO_CORRESPONDE" else client, []))
                continue
        client = next((c for a, c in alias_map.items() if a and a in text), None)
        how = "alias"
        if client is None:
            how = "directo"
            client = next(
                (c for c in clients if c in text or any(len(t) > 3 and t in text for t in c.split())), None
            )
        if client is None:
            out.append(("CLIENTE_DESCONOCIDO", "ninguno", "ninguno", None, []))
            continue
        own = by_client.get(client, [])
        hits = [x for x, v in own if abs(v - amount) <= 1]
        sums = []
        if len(own) <= 15 and not hits:
            for k in range(2, min(4, len(own)) + 1):
                sums += [[x for x, _ in c] for c in combinations(own, k) if abs(sum(v for _, v in c) - amount) <= 1]
        quoted = [x for x, _ in own if x and x in text]
        if len(hits) == 1:
            out.append(("ASOCIADO", "exacto", how, client, hits))
        elif hits:
            out.append(("AMBIGUO", "exacto_multiple", how, client, hits))
        elif len(sums) == 1:
            out.append(("ASOCIADO", "acumulado", how, client, sums[0]))
        elif sums:
            out.append(("AMBIGUO", "acumulado_multiple", how, client, sums[0]))
        elif quoted:
            out.append(("ASOCIADO", "referencia", how, client, quoted))
        else:
            out.append(("NO_IDENTIFICADO", "ninguno", how, client, []))
    return out


def outcomes(matches):
    rows = matches.orderBy("payment_id").collect()
    return [(r.match_state, r.match_method, r.client_method, r.client, list(r.documents)) for r in rows]
