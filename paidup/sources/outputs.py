"""Result tables of a run: Parquet, and CSV for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from paidup.operators.reports import DETAIL_COLUMNS
from paidup.schemas import MATCH_RESULT, OPEN_ITEMS
from paidup.sources.ledgers import list_text, text_list

CONSOLIDATED = T.StructType(
    [
        *OPEN_ITEMS.fields,
        T.StructField("payment_id", T.LongType()),
        T.StructField("match_method", T.StringType()),
        T.StructField("payment_date", T.DateType()),
        T.StructField("is_paid", T.BooleanType()),
        T.StructField("invoice_state", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("origin", T.StringType()),
    ]
)
EXCEPTIONS = T.StructType([*MATCH_RESULT.fields, T.StructField("origin", T.StringType())])


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result table; empty when no run has written it yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; arrays as ``['A', 'B']`` text."""
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            df = df.withColumn(field.name, list_text(F.col(field.name)))
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def export_detail(filtered: DataFrame, path: str) -> None:
    """The nine columns of the filtered invoice list."""
    filtered.select(*DETAIL_COLUMNS).write.mode("overwrite").csv(path, header=True)


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by ``export_csv``."""
    arrays = {f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)}
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in arrays else f.dataType) for f in schema.fields])
    rows = spark.read.schema(text).csv(path, header=True, escape='"', multiLine=True)
    return rows.select(*[text_list(F.col(f.name)).alias(f.name) if f.name in arrays else f.name for f in schema.fields])
