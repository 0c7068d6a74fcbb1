"""The log of runs: what a run has promised to the history, so that it can be finished after a failure.

A run first writes its outputs and the rows it will append (the pending rows), then logs ``prepared``, then
appends, then logs ``done``. Before ``prepared`` nothing outside the run's own folder of outputs has changed, and the
run is simply started again. After it, the append is finished from the pending rows, as often as need be: the
ledger knows what an earlier attempt wrote by the run's id. One run at a time works on a folder of outputs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paidup.sources.outputs import read_table

LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("inputs", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("logged_at", T.TimestampType()),
    ]
)
PREPARED, DONE = "prepared", "done"


@dataclass(frozen=True)
class PreparedRun:
    run_id: str
    inputs: str


def log_path(output: str) -> str:
    return f"{output}/runs"


def pending_path(output: str, run_id: str) -> str:
    return f"{output}/pending/{run_id}"


def log_step(spark: SparkSession, output: str, run: PreparedRun, step: str) -> None:
    """One row in one file: the log either has the step or has not."""
    row = [(run.run_id, run.inputs, step, dt.datetime.now())]
    spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(log_path(output))


def prepared_runs(spark: SparkSession, output: str) -> list[PreparedRun]:
    """Runs whose append may not be whole, oldest first: one at most, unless their finishing failed as well."""
    log = read_table(spark, log_path(output), LOG)
    rows = (
        log.groupBy("run_id", "inputs")
        .agg(F.min("logged_at").alias("at"), F.bool_or(F.col("step") == DONE).alias("done"))
        .filter(~F.col("done"))
        .orderBy("at")
        .collect()
    )
    return [PreparedRun(r.run_id, r.inputs) for r in rows]


def content_of(df: DataFrame) -> str:
    """Number of rows and a sum over the rows' hashes: tables of the same rows have the same, in any order."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("total")
    ).first()
    return f"{row.n}:{row.total or 0}"
