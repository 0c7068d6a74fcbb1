"""Connected components of a table of links, by alternating stars; no node's links meet in one task.

Each round of stars is several shuffles, whatever the size of the table. What is down to ``FEW`` links, a number
that does not grow with the input, is finished by one task instead: the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.workspace import Workspace

#: Links, 2 MB of them, that one task takes.
FEW = 1 << 17


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours, with the smallest of them and the node itself."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a")


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while len(x):
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(top, up := top[top]):
            top = up
        x, y = top[x], top[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[top]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
    if whole:
        found = united(*(np.concatenate(side) for side in zip(*whole)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "component"])


def components(workspace: Workspace, links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node."""
    now = workspace.stage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        if state[0] <= FEW:
            return workspace.stage(now.coalesce(1).mapInArrow(_finished, "node long, component long"), "components")
        before = state
        large = _star(now).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        now = workspace.stage(small.unionAll(down.select("a", F.col("least").alias("b"))).distinct(), "stars")
