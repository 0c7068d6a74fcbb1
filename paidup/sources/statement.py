"""Bank statements: CSV without header, ten positional fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paidup.functions.dates import statement_date
from paidup.functions.money import parse_int, parse_money
from paidup.functions.text import normal, strip
from paidup.operators.classify import date_mask, flow_of
from paidup.schemas import MOVEMENTS, MOVEMENTS_RAW
from paidup.sources.ordinals import with_line_ordinal
from paidup.workspace import Workspace


def read_raw_statement(spark: SparkSession, path: str) -> DataFrame:
    """The file as text fields. Raises when the first line has not exactly ten fields; a missing
    path raises Spark's PATH_NOT_FOUND. Later lines of another width keep their text in
    ``_corrupt_record``."""
    expected = len(MOVEMENTS_RAW.fields)
    found = len(spark.read.csv(path, header=False, encoding="UTF-8").columns)
    if found != expected:
        raise ValueError(f"the statement has {found} columns, expected {expected}")
    schema = T.StructType([*MOVEMENTS_RAW.fields, T.StructField("_corrupt_record", T.StringType(), True)])
    return spark.read.schema(schema).csv(path, header=False, encoding="UTF-8", mode="PERMISSIVE")


def typed_movements(raw: DataFrame) -> DataFrame:
    """Typed movements from the text fields and ``movement_ord``; bad values become null."""
    amount = parse_money(F.col("amount"))
    return raw.select(
        "movement_ord",
        strip(F.col("account")).alias("account"),
        statement_date(F.col("date_raw")).alias("value_date"),
        amount.alias("amount"),
        F.abs(amount).alias("amount_abs"),
        flow_of(amount).alias("flow"),
        parse_int(F.col("code")).alias("bank_code"),
        normal(F.col("description")).alias("description"),
    )


def read_statement(
    spark: SparkSession,
    path: str,
    date_from=None,
    date_to=None,
    ws: Workspace | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Movements of a statement, optionally within an inclusive date range.

    ``observation`` receives ``discarded`` and ``without_date`` once the result is computed.
    """
    ws = ws or Workspace(spark)
    raw = with_line_ordinal(read_raw_statement(spark, path), "movement_ord", ws)
    rows = typed_movements(raw.filter(F.col("_corrupt_record").isNull()))
    kept = date_mask(date_from, date_to)
    if observation is not None:
        rows = rows.observe(
            observation,
            F.count_if(~kept).alias("discarded"),
            F.count_if(F.col("value_date").isNull()).alias("without_date"),
        )
    return rows.filter(kept).select(*MOVEMENTS.fieldNames())


def rejected_lines(spark: SparkSession, path: str, ws: Workspace | None = None) -> DataFrame:
    """Lines of a statement that have not ten fields, with their position."""
    raw = with_line_ordinal(read_raw_statement(spark, path), "movement_ord", ws or Workspace(spark))
    return raw.filter(F.col("_corrupt_record").isNotNull()).select("movement_ord", F.col("_corrupt_record").alias("line"))
