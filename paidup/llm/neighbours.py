"""Nearest neighbours by inner product, found by cross-polytope hashing.

A table of the index turns every vector by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and files it under its nearest signed axis. A query looks into the cells of its
``PROBES`` best signed axes of each of ``TABLES`` tables (in more than 64 dimensions as many more as
there are more axes), and everything found there is ranked by the exact inner product. Only directions
are filed. What is found for its norm rather than its direction is in the head: about ``HEAD`` entries
of the largest norms, which meet every query, so every query finds ``k`` vectors where there are so many.

Equal vectors are one entry of the index with the smallest ids that can be in an answer, so a vector
with many copies does not fill a cell. Cells are cut into parts of bounded size on both sides. There
is no cap on candidates: recall is a matter of ``TABLES``, ``PROBES`` and ``HEAD`` alone.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
a vec_id; rows that repeat id and vector count once. Only vectors of one length are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paidup.llm.session import prepared
from paidup.workspace import Workspace

TABLES, PROBES = 8, 16
#: Entries of the largest norms that are compared with every query, about.
HEAD = 1024
#: Components of the vectors of a batch that leaves the hashing, about.
BATCH = 1 << 22
#: Vectors and queries of one part of a cell.
PART, QUERIES = 4096, 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, size = x.shape[1], 1
    while size < n:
        pair = x.reshape(len(x), n // (2 * size), 2, size)
        x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(len(x), n)
        size *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(int(x.shape[1] - 1).bit_length(), 1)
    signs = np.random.default_rng([table, width]).choice([-1.0, 1.0], (3, width))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for own in signs:
        x = hadamard(x * own)
    return x


def cells(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, best first: axis i is 2 i, its opposite 2 i + 1."""
    y = rotated(x, table)
    order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :probes]
    return 2 * order + (np.take_along_axis(y, order, 1) < 0)


def _filed(tables: int, probes: int):
    """A row for each cell that a vector is filed under (probes 0) or a query looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column("vector").to_numpy(zero_copy_only=False)]
            size = np.array([len(v) for v in vectors])
            for dim in np.unique(size).tolist():
                looks = probes * max(1, (1 << int(dim - 1).bit_length()) // 64) or 1
                step = max(1, BATCH // (tables * looks * dim))
                all_ = np.flatnonzero(size == dim)
                for own in (all_[i : i + step] for i in range(0, len(all_), step)):
                    x = np.stack([vectors[i] for i in own])
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    found = np.stack([cells(unit, t, looks) for t in range(tables)], axis=1)
                    rows = batch.take(pa.array(np.repeat(own, found.shape[1] * found.shape[2])))
                    table = np.tile(np.repeat(np.arange(tables), found.shape[2]), len(own))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(table), dim), pa.int32()),
                            pa.array(table, pa.int32()),
                            pa.array(found.reshape(-1), pa.int32()),
                            rows.column("uid"),
                            rows.column("vector"),
                            rows.column("ids"),
                        ],
                        ["dim", "table", "cell", "uid", "vector", "ids"],
                    )

    return run


def _head(entries: DataFrame) -> DataFrame:
    """The entries of the largest norms of each length: whole bands of norms, and a part of the next by hash."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    banded = entries.withColumn("dim", F.size("vector")).withColumn("band", F.floor(F.log2(norm) * 8))
    bands = banded.groupBy("dim", "band").agg(F.count("*").alias("n"))
    larger = F.sum("n").over(Window.partitionBy("dim").orderBy(F.desc("band"))) - F.col("n")
    bands = bands.withColumn("room", HEAD - larger).filter("room > 0")
    bands = bands.select("dim", "band", F.ceil(F.col("n") / F.col("room")).alias("every"))  # at most HEAD rows of a length
    return banded.join(F.broadcast(bands), ["dim", "band"]).filter(F.pmod(F.xxhash64("uid"), F.col("every")) == 0)


def _ranked(k: int):
    """The best k + 1 ids of every query of a part of a cell, packed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked, there = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(asked) or not len(there):
            return pd.DataFrame({"uid": [], "ids": [], "scores": []}).astype({"uid": "int64"})
        q, x = (np.stack(side["vector"].to_numpy()).astype(np.float64) for side in (asked, there))
        scores = q @ x.T
        top = min(k + 1, len(x))
        # all that are level with the last of the best, but for rounding
        least = -np.partition(-scores, top - 1, axis=1)[:, top - 1]
        least -= 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        ids = there["ids"].to_numpy()
        out_ids, out_scores = [], []
        for i in range(len(q)):
            best = np.flatnonzero(scores[i] >= least[i])
            exact = (x[best] * q[i]).sum(axis=1)
            own = [ids[j] for j in best]
            flat = np.concatenate(own).astype(np.int64)
            score = np.repeat(exact, [len(o) for o in own])
            order = np.lexsort((flat, -score))[: k + 1]
            out_ids.append(flat[order].tobytes())
            out_scores.append(score[order].tobytes())
        return pd.DataFrame({"uid": asked["uid"].to_numpy(), "ids": out_ids, "scores": out_scores})

    return run


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_scores = [], []
            for parts in batch.column("parts").to_pylist():
                ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
                scores = np.concatenate([np.frombuffer(p["scores"], np.float64) for p in parts])
                ids, first = np.unique(ids, return_index=True)
                scores = scores[first]
                order = np.lexsort((ids, -scores))[: k + 1]
                all_ids.append(ids[order])
                all_scores.append(scores[order])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"),
                    pa.array(all_ids, pa.list_(pa.int64())),
                    pa.array(all_scores, pa.list_(pa.float64())),
                ],
                ["uid", "ids", "scores"],
            )

    return run


def nearest(vectors: DataFrame, queries, k: int = 20, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that meet the condition ``queries``, against all rows."""
    spark = prepared(vectors.sparkSession, 1024)
    workspace = Workspace(spark)
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter("vec_id is not null and vector is not null").filter(sound)
    own = own.filter(F.exists("vector", lambda x: x != 0)).distinct()
    own = workspace.stage(own.withColumn("uid", F.xxhash64("vector")), "vectors")
    first = Window.partitionBy("uid").orderBy("vec_id")
    few = own.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    entries = few.groupBy("uid").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = workspace.stage(entries, "entries")
    asked = own.filter(queries).select("vec_id", "uid")
    asks = entries.join(asked.select("uid").distinct(), "uid", "left_semi").select("uid", "vector", F.lit(None).cast("array<long>").alias("ids"))
    kind = "dim int, table int, cell int, uid long, vector array<double>, ids array<long>"
    head = [F.size("vector").alias("dim"), F.lit(-1).alias("table"), F.lit(0).alias("cell"), "uid", "vector", "ids"]
    filed = entries.mapInArrow(_filed(tables, 0), kind).unionAll(_head(entries).select(*head))
    looking = asks.mapInArrow(_filed(tables, probes), kind).unionAll(asks.select(*head))
    filed, looking = workspace.stage(filed, "filed"), workspace.stage(looking, "looking")
    key = ["dim", "table", "cell"]
    parts = filed.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    rounds = looking.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("rounds"))
    sizes = parts.join(rounds, key)

    def number(n: str):
        return F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    there = filed.join(sizes, key).select(*key, number("parts").alias("part"), all_of("rounds").alias("round"), "uid", "vector", "ids", F.lit(False).alias("asks"))
    here = looking.join(sizes, key).select(*key, all_of("parts").alias("part"), number("rounds").alias("round"), "uid", "vector", "ids", F.lit(True).alias("asks"))
    found = there.unionAll(here).groupBy(*key, "part", "round").applyInPandas(_ranked(k), "uid long, ids binary, scores binary")
    best = found.groupBy("uid").agg(F.collect_list(F.struct("ids", "scores")).alias("parts"))
    best = best.mapInArrow(_merged(k), "uid long, ids array<long>, scores array<double>")
    pairs = asked.join(best, "uid").select(
        F.col("vec_id").alias("query_id"),
        F.slice(
            F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("vec_id")), 1, k
        ).alias("found"),
    )
    return pairs.select("query_id", F.posexplode("found").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")
    )


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
