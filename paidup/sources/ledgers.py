"""Ledgers: append-only Parquet tables, and the CSV files they are exchanged as."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from paidup.config import ACTIVE
from paidup.functions.dates import day_first_date
from paidup.functions.fingerprint import payment_fingerprint
from paidup.functions.money import parse_int, parse_money
from paidup.functions.text import blank_to_null
from paidup.operators.ledger import new_aliases, shaped
from paidup.schemas import (
    ALIAS_FILE_COLUMNS,
    ALIASES,
    DECISION_FILE_COLUMNS,
    DECISIONS,
    HISTORY,
    HISTORY_FILE_COLUMNS,
)
from paidup.sources.ordinals import with_line_ordinal
from paidup.workspace import Workspace

# Append order: every append has a later batch than the one before; pos orders the rows of one.
# append_id names the request that an append belongs to, so that it can be repeated.
_ORDER = [
    T.StructField("batch", T.LongType(), True),
    T.StructField("pos", T.LongType(), True),
    T.StructField("append_id", T.StringType(), True),
]
_ORDER_NAMES = [f.name for f in _ORDER]
# The history is stored by the month that its fingerprints contain.
_MONTH = T.StructField("fingerprint_month", T.DateType(), True)


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, *_ORDER])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A typed read; a ledger that does not exist yet is empty."""
    stored = _stored(schema)
    try:
        return spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stored)


def _next_batch(stored: DataFrame) -> int:
    """Later than every batch of the ledger, whatever the clock says."""
    last = stored.agg(F.max("batch")).first()[0] or 0
    return max(last + 1, time.time_ns())


def _append(
    rows: DataFrame, path: str, schema: T.StructType, append_id: str | None = None, by: T.StructField | None = None
) -> None:
    """Rows keep the order of their ``request_ord``; without one, the order they stand in.

    With an ``append_id`` the append can be repeated after a failure at any point: rows that an earlier attempt of
    the same id wrote are not written again, and the others join its batch. That needs a ``request_ord`` that is
    the row's own in every attempt. ``by`` is a column to lay the files out by.
    """
    if append_id is not None and "request_ord" not in rows.columns:
        raise ValueError("a repeatable append needs request_ord")
    pos = F.col("request_ord").cast("long") if "request_ord" in rows.columns else F.monotonically_increasing_id()
    shaped_ = T.StructType([*schema.fields, T.StructField("pos", T.LongType(), True), *([by] if by else [])])
    stored = _read(rows.sparkSession, path, T.StructType([*schema.fields, *([by] if by else [])]))
    written = stored.filter(F.col("append_id") == append_id) if append_id is not None else None
    batch = written.agg(F.max("batch")).first()[0] if written is not None else None
    out = shaped(rows.withColumn("pos", pos), shaped_)
    if batch is not None:
        out = out.join(written.select("pos").distinct(), "pos", "left_anti")
    out = out.withColumn("batch", F.lit(batch or _next_batch(stored))).withColumn(
        "append_id", F.lit(append_id).cast("string")
    )
    out = out.select(*_stored(schema).fieldNames(), *([by.name] if by else []))
    if by is None:
        out.write.mode("append").parquet(path)
    else:  # one file or a few per month, however the rows are dealt
        out.hint("rebalance", by.name).write.mode("append").partitionBy(by.name).parquet(path)


def append_order() -> Column:
    return F.struct("batch", "pos")


# --- decisions --------------------------------------------------------------------------------


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions with ``decision_ord``. Rows written before states existed count as active."""
    rows = _read(spark, path, DECISIONS).withColumn("decision_ord", append_order()).drop(*_ORDER_NAMES)
    return rows.withColumn("decision_state", F.coalesce("decision_state", F.lit(ACTIVE)))


def append_decisions(rows: DataFrame, path: str, append_id: str | None = None) -> None:
    _append(rows, path, DECISIONS, append_id)


def read_decision_file(spark: SparkSession, path: str, ws: Workspace | None = None) -> DataFrame:
    """Decisions from a CSV file with or without the state column; order is the order of lines."""
    raw = with_line_ordinal(spark.read.csv(path, header=True, encoding="UTF-8"), "decision_ord", ws or Workspace(spark))
    rows = raw.select(
        "decision_ord",
        *[F.col(f"`{old}`").alias(new) for old, new in DECISION_FILE_COLUMNS.items() if old in raw.columns],
    )
    if "decision_state" not in rows.columns:
        rows = rows.withColumn("decision_state", F.lit(ACTIVE))
    return rows.select(
        F.try_to_timestamp("decided_at").alias("decided_at"),
        "fingerprint",
        parse_int(F.col("origin_payment_id")).cast("long").alias("origin_payment_id"),
        parse_money(F.col("amount")).alias("amount"),
        *[blank_to_null(F.col(c)).alias(c) for c in DECISIONS.fieldNames()[4:11]],
        F.coalesce(blank_to_null(F.col("decision_state")), F.lit(ACTIVE)).alias("decision_state"),
        "decision_ord",
    )


# --- history ----------------------------------------------------------------------------------


def read_history(
    spark: SparkSession, path: str, since: dt.date | None = None, until: dt.date | None = None, without: str | None = None
) -> DataFrame:
    """The history; with ``since`` and ``until``, only what payments of these days can meet.

    A payment's fingerprint contains its day, so other months are not scanned. Rows whose fingerprint is not that
    of their own fields may belong to any day and are always read. ``without`` leaves out the rows of one run.
    """
    rows = _read(spark, path, T.StructType([*HISTORY.fields, _MONTH]))
    if since is not None and until is not None:
        month = F.col(_MONTH.name)
        rows = rows.filter(month.isNull() | month.between(F.lit(since.replace(day=1)), F.lit(until.replace(day=1))))
    if without is not None:
        rows = rows.filter(~F.col("append_id").eqNullSafe(without))
    return rows.select(*HISTORY.fieldNames())


def append_history(rows: DataFrame, path: str, append_id: str | None = None) -> None:
    """Append to the history, laid out by month of payment where the fingerprint proves the payment's day.

    A history of the flat layout is refused, because Spark would no longer see its files beside folders of months;
    it is brought in by reading it and appending it to a new path.
    """
    if _is_flat(rows.sparkSession, path):
        raise ValueError(f"{path} is not laid out by {_MONTH.name}: append its rows to a new path first")
    own = payment_fingerprint(F.col("description"), F.col("amount"), F.col("payment_date"))
    month = F.when(F.col("fingerprint") == own, F.trunc("payment_date", "month"))
    _append(rows.withColumn(_MONTH.name, month), path, HISTORY, append_id, _MONTH)


def _is_flat(spark: SparkSession, path: str) -> bool:
    try:
        return _MONTH.name not in spark.read.parquet(path).columns
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def read_run_times(spark: SparkSession, path: str) -> DataFrame:
    """The run timestamps of the history; the scan reads that column only."""
    return read_history(spark, path).select("run_at")


def read_history_file(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    rows = raw.select(*[F.col(f"`{old}`").alias(new) for old, new in HISTORY_FILE_COLUMNS.items()])
    return rows.select(
        F.try_to_timestamp("run_at").alias("run_at"),
        "fingerprint",
        day_first_date(F.col("payment_date")).alias("payment_date"),
        parse_money(F.col("amount")).alias("amount"),
        "description",
        "initial_state",
        "match_method",
        text_list(F.col("documents")).alias("documents"),
    )


_ITEM = r"""(?:'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")"""


def list_is_readable(text: Column) -> Column:
    """Whether the text is a list of quoted items, in either quote character."""
    return text.rlike(rf"(?s)^\s*\[\s*(?:{_ITEM}(?:\s*,\s*{_ITEM})*+)?\s*,?\s*\]\s*$")


def text_list(text: Column) -> Column:
    """``['A', "B's"]`` as an array; missing or malformed text as an empty one."""
    items = F.regexp_extract_all(text, F.lit("(?s)" + _ITEM), F.lit(0))

    def plain(item: Column) -> Column:
        mark = "\u0001"
        inner = F.replace(F.substring(item, F.lit(2), F.length(item) - 2), F.lit("\\\\"), F.lit(mark))
        for written, meant in (("\\'", "'"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (mark, "\\")):
            inner = F.replace(inner, F.lit(written), F.lit(meant))
        return inner

    unquoted = F.from_json(text, "array<string>")
    parsed = F.when(list_is_readable(text), F.transform(items, plain)).otherwise(unquoted)
    return F.coalesce(parsed, F.array().cast("array<string>"))


def list_text(items: Column) -> Column:
    """An array as text that ``text_list`` reads back."""

    def quoted(item: Column) -> Column:
        for meant, written in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            item = F.replace(item, F.lit(meant), F.lit(written))
        return F.concat(F.lit("'"), item, F.lit("'"))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


# --- aliases ----------------------------------------------------------------------------------


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """The alias catalogue, one row per alias in order of first appearance."""
    rows = _read(spark, path, T.StructType(ALIASES.fields[:3])).withColumn("alias_ord", append_order())
    return rows.drop(*_ORDER_NAMES)


def add_aliases(requested: DataFrame, path: str, append_id: str | None = None) -> None:
    """Append the aliases that the catalogue lacks."""
    spark = requested.sparkSession
    existing = Workspace(spark).stage(read_aliases(spark, path).select("alias"), "known-aliases")
    _append(new_aliases(requested, existing), path, T.StructType(ALIASES.fields[:3]), append_id)


def read_alias_file(spark: SparkSession, path: str, ws: Workspace | None = None) -> DataFrame:
    """Aliases from a CSV file with ``#`` comment lines; a missing file is an empty catalogue."""
    try:
        raw = spark.read.csv(path, header=True, encoding="UTF-8", comment="#")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ALIASES)
    raw = with_line_ordinal(raw, "alias_ord", ws or Workspace(spark))
    names = {old: new for old, new in ALIAS_FILE_COLUMNS.items() if old in raw.columns}
    rows = raw.select("alias_ord", *[F.col(f"`{old}`").alias(new) for old, new in names.items()])
    return shaped(rows, ALIASES)

