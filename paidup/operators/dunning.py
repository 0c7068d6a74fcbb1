"""Collection letters: one per client with unpaid invoices, toned by the worst aging band.

A letter is an ordered document of rows: the text up to the head of its invoice table, a line per invoice, and the total with
the rest of the text. No client is gathered, so a letter may have any number of invoices.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paidup.config import STAGE_LABELS
from paidup.functions.dates import cutoff_date, iso_text, long_spanish_date
from paidup.functions.labels import dunning_stage, mapped, stage_label
from paidup.functions.money import currency_text
from paidup.functions.text import strip
from paidup.operators.aging import worst_band
from paidup.skew import hot_keys, lookup
from paidup.sources.ordinals import dense_positions
from paidup.workspace import Workspace

DEADLINE_DAYS = 7

SUBJECTS = {
    "SEMANA_0": "Estado de cuenta de {client}",
    "SEMANA_1_3": "{client}: facturas vencidas por pagar",
    "SEMANA_4": "{client}: aviso previo de suspensión",
    "SEMANA_5": "{client}: segundo aviso previo de suspensión",
    "SEMANA_6": "{client}: suspensión del servicio",
}
TEMPLATES = {
    "SEMANA_0": "Señores {client}:\n\nEste es su estado de cuenta de hoy.\n\n{table}\n\n"
    "Si algo no coincide con sus registros, por favor respondan este mensaje.\n",
    "SEMANA_1_3": "Señores {client}:\n\nTienen facturas vencidas. Les pedimos pagarlas pronto.\n\n{table}\n\n"
    "Si ya pagaron, envíen el comprobante y no tengan en cuenta este aviso.\n",
    "SEMANA_4": "Señores {client}:\n\nSu cartera pasa de 60 días. Sin un pago antes del {deadline} "
    "habrá que suspender el servicio.\n\n{table}\n",
    "SEMANA_5": "Señores {client}:\n\nNo hemos recibido respuesta al aviso anterior. La fecha límite de pago es "
    "el {deadline}.\n\n{table}\n",
    "SEMANA_6": "Señores {client}:\n\nEl servicio queda suspendido hasta recibir el pago de estas facturas.\n\n{table}\n",
}
# Layout of the invoice table.
TABLE_HEADER = "| Documento | Vencimiento | Días vencido | Saldo |\n|---|---|---:|---:|"

# The text of a letter before and after the lines of its table.
OPENINGS = {stage: text.split("{table}")[0] + TABLE_HEADER for stage, text in TEMPLATES.items()}
CLOSINGS = {stage: text.split("{table}")[1] for stage, text in TEMPLATES.items()}

_LAST = 2147483647


def invoice_line() -> Column:
    day = F.coalesce(iso_text(F.col("due_date")), F.lit(""))
    days = F.coalesce(F.col("days_overdue").cast("string"), F.lit(""))
    return F.concat(
        F.lit("| "), strip(F.col("document")), F.lit(" | "), day, F.lit(" | "), days, F.lit(" | "),
        currency_text(F.col("open_amount")), F.lit(" |"),
    )


def total_line(total: Column) -> Column:
    return F.concat(F.lit("| **TOTAL** |  |  | **"), currency_text(total), F.lit("** |"))


def _filled(template: Column, deadline: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{deadline}"), deadline), F.lit("{client}"), F.col("client"))


def dunning_letters(base: DataFrame, today: dt.date | str | None = None) -> DataFrame:
    """One row per client: its letter without the lines of the table (``opening``, ``closing``), and what it is about."""
    deadline = long_spanish_date(F.lit(cutoff_date(today) + dt.timedelta(days=DEADLINE_DAYS)))
    clients = (
        base.filter(~F.col("is_paid"))
        .groupBy("client")
        .agg(
            F.count(F.lit(1)).alias("invoices"),
            F.sum("open_amount").alias("total"),
            worst_band(F.col("aging_band")).alias("worst_band"),
        )
        .withColumn("stage", dunning_stage(F.col("worst_band")))
    )
    return clients.select(
        "client",
        "invoices",
        "total",
        "worst_band",
        "stage",
        stage_label(F.col("stage")).alias("stage_label"),
        F.replace(mapped(F.col("stage"), SUBJECTS), F.lit("{client}"), F.col("client")).alias("subject"),
        _filled(mapped(F.col("stage"), OPENINGS), deadline).alias("opening"),
        F.concat(total_line(F.col("total")), _filled(mapped(F.col("stage"), CLOSINGS), deadline)).alias("closing"),
    )


def _unpaid_lines(base: DataFrame) -> DataFrame:
    return base.filter(~F.col("is_paid")).select(
        "client", F.coalesce(-F.col("days_overdue"), F.lit(_LAST)).alias("day_key"), "document", "item_ord", invoice_line().alias("line")
    )


def letter_bodies(base: DataFrame, today: dt.date | str | None = None) -> DataFrame:
    """One row per client: its whole letter as one text, ``body``, and what it is about.

    The lines of a client meet in its row, as the text is one value; ``letter_rows`` has the same letter as rows, at any length.
    """
    entry = F.struct("day_key", "document", "item_ord", "line")
    lines = _unpaid_lines(base).groupBy(F.col("client").alias("__client")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    table = F.array_join(F.transform("entries", lambda e: e["line"]), "\n")
    letters = dunning_letters(base, today)
    body = F.concat_ws("\n", "opening", table, "closing").alias("body")
    return letters.join(lines, F.col("client").eqNullSafe(F.col("__client"))).select(
        *[c for c in letters.columns if c not in ("opening", "closing")], body
    )


def dunning_lines(base: DataFrame, ws: Workspace) -> DataFrame:
    """(client, pos, line): the lines of all letters, from the most overdue invoice down, then by document.

    One sort of all unpaid invoices, cut into ranges: a client with many invoices is spread over as many tasks
    as it fills. ``pos`` counts from 1 within the client.
    """
    placed = ws.stage(dense_positions(_unpaid_lines(base), ["client", "day_key", "document", "item_ord"], "place", ws), "lines")
    firsts = placed.groupBy("client").agg(F.min("place").alias("first"))
    (hot,) = hot_keys(placed, ["client"])
    return lookup(placed, firsts, ["client"], "inner", hot, ["place"]).select(
        "client", (F.col("place") - F.col("first") + 1).alias("pos"), "line"
    )


def letter_rows(letters: DataFrame, lines: DataFrame) -> DataFrame:
    """(client, pos, text): every letter as rows in order; joined by line feeds they are its body."""
    opening = letters.select("client", F.lit(0).cast("long").alias("pos"), F.col("opening").alias("text"))
    closing = letters.select("client", (F.col("invoices") + 1).alias("pos"), F.col("closing").alias("text"))
    return opening.unionByName(lines.withColumnRenamed("line", "text")).unionByName(closing)


def write_letters(letters: DataFrame, lines: DataFrame, path: str) -> None:
    """All letters as Parquet rows in order: files and the rows in them run by client and position."""
    letter_rows(letters, lines).orderBy("client", "pos").write.mode("overwrite").parquet(path)


def client_stages(base: DataFrame) -> DataFrame:
    """Worst band, stage and label of each client with unpaid invoices."""
    return (
        base.filter(~F.col("is_paid"))
        .groupBy("client")
        .agg(worst_band(F.col("aging_band")).alias("worst_band"))
        .withColumn("stage", dunning_stage(F.col("worst_band")))
        .withColumn("stage_label", stage_label(F.col("stage")))
    )


assert set(SUBJECTS) == set(TEMPLATES) == set(STAGE_LABELS)
