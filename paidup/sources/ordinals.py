"""Position of rows in their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paidup.workspace import Workspace


def with_line_ordinal(scan: DataFrame, name: str, ws: Workspace) -> DataFrame:
    """Add ``name``: the 0-based position of each row over all files in path order.

    ``scan`` must be a direct file scan. Rows are staged once with the split they came from, so
    that numbering does not depend on how a second scan would be cut. Only the row counts of the
    splits are ordered in one place (one small row per split).
    """
    columns = scan.columns
    tagged = ws.stage(
        scan.select(
            *columns,
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        f"scan-{name}",
    )
    before = F.sum("__n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))
    splits = (
        tagged.groupBy("__file", "__block")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
        .select("__file", "__block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    )
    return tagged.join(splits, ["__file", "__block"]).select(
        (F.col("__row") + F.col("__shift")).alias(name), *columns
    )


def dense_positions(df: DataFrame, order: str | Sequence[str], name: str, ws: Workspace) -> DataFrame:
    """Add ``name``: 0-based dense position by the column or columns ``order``, unique together.

    A range-partitioned sort is staged; its files are in order, so their row positions are the ranks.
    """
    ordered = ws.stage(df.orderBy(order), f"sorted-{name}")
    return with_line_ordinal(ordered, name, ws)
