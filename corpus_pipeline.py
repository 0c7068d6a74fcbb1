"""A corpus from raw documents: the stages in order, each a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paidup.llm.decontaminate import without_contaminated
from paidup.llm.language import with_known_language
from paidup.llm.near_copies import one_of_each
from paidup.llm.packing import packed_corpus
from paidup.llm.repeats import without_repeats
from paidup.workspace import Workspace

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", with_known_language),
    ("near_dedup", one_of_each),
    ("repeated_passages", without_repeats),
    ("benchmark_decontamination", without_contaminated),
    ("packing", packed_corpus),
]

#: SQL has neither the learned model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage works on all rows that the stage before it kept."""
    workspace = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.stage(stage(spark, docs, sf_dir), name)
    return docs
