"""Joins that stay balanced when one key holds a large share of the rows.

The fact side of every lookup below may be skewed without bound; the looked-up side has at most
one row per key. Heavy keys are found by a mergeable frequent-items sketch (one pass, no shuffle of
the rows); only their rows are salted, and only their lookup rows are repeated. The lookups give the same
rows whatever the sketch reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paidup.config import SkewSettings

_SALT = "__salt"
_MERGERS = 256


def _key_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(
    df: DataFrame, *keys: Sequence[str], settings: SkewSettings = SkewSettings()
) -> list[list[int]]:
    """For each key (a list of columns) the hashes of the values that hold very many rows.

    One pass answers all keys. Sketches merge in two levels, so that the last task reads a fixed
    number of them; at most ``settings.most_keys`` hashes per key come back to the driver.
    """
    names = [f"k{i}" for i in range(len(keys))]
    hashed = df.select(*[_key_hash(key).alias(name) for name, key in zip(names, keys)])
    row = (
        hashed.groupBy(F.pmod(F.spark_partition_id(), F.lit(_MERGERS)).alias("merger"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.expr(f"approx_top_k_accumulate({k}, {settings.tracked})").alias(k) for k in names],
        )
        .groupBy(F.pmod("merger", F.lit(1)))  # no row at all for an empty table
        .agg(F.sum("n").alias("n"), *[F.expr(f"approx_top_k_combine({k}, {settings.tracked})").alias(k) for k in names])
        .select("n", *[F.expr(f"approx_top_k_estimate({k}, {settings.most_keys})").alias(k) for k in names])
        .first()
    )
    if row is None:
        return [[] for _ in keys]
    floor = max(settings.min_rows, row["n"] * max(settings.min_share, 1 / _partitions(df)))
    return [[entry["item"] for entry in row[k] or () if entry["count"] >= floor] for k in names]


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot: Sequence[int] = (),
    spread: Sequence[str] = (),
    settings: SkewSettings = SkewSettings(),
) -> DataFrame:
    """Join ``fact`` with ``dim`` (unique on ``on``), salting the ``hot`` keys.

    ``spread`` names fact columns that tell the rows of one key apart.
    """
    on = list(on)
    if not hot:
        return fact.join(dim, on, how)
    is_hot = _key_hash(on).isin(list(hot))
    salts = settings.salts or _partitions(fact)
    salted_fact = fact.withColumn(
        _SALT, F.when(is_hot, F.pmod(_key_hash(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    salted_dim = dim.withColumn(
        _SALT,
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted_fact.join(salted_dim, [*on, _SALT], how).drop(_SALT)


def short_lists(rows: DataFrame, keys: Sequence[str], order: str, entry: Column, limit: int) -> DataFrame:
    """Per key the first ``limit`` entries by ``order``, as ``entries``; no group is gathered whole.

    The rank filter lets Spark cut every group to ``limit`` rows before the shuffle, so a key with very many rows
    sends at most so many from each task.
    """
    keys = list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (
        rows.select(*keys, order, entry.alias("__entry"), rank.alias("__rank"))
        .filter(F.col("__rank") <= limit)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("__entry")).alias("entries"))
    )

