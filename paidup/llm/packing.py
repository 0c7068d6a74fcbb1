"""Best-fit packing of documents into token sequences, with bounds that certify the result.

Documents are cut into pieces of at most ``LENGTH`` ids; a full piece is a sequence of its own. The
others are dealt to groups of bounded size, each is packed by best fit over decreasing lengths, and
lower bounds from dual feasible functions are compared with the number of sequences. A group without
a gap is proven and stays. The groups with a gap keep the sequences that are quite full, exchange the
pieces of all others, are dealt anew in groups of the same bounded size and packed again. When a round
settles little, exchange does not help these sizes: all its groups stay as they are, not certified.

Null and empty texts are pieces of the end id alone. Rows repeat as given; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.llm.pieces import encoder, tokenizer_path, with_end
from paidup.llm.session import prepared
from paidup.llm.text import blocks
from paidup.workspace import Workspace

LENGTH = 2048
#: Pieces of a group.
GROUP = 60_000
#: Share of the open pieces that a round has to settle for another one to follow.
SETTLED = 0.1

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, drops_space: bool, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                ids, counts = encoder(path, drops_space).encode(batch.column("text"))
                ids, bounds = with_end(ids, counts, end)
                sizes = np.diff(bounds)
                n = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                size = np.minimum(length, sizes[doc] - start)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip((bounds[doc] + start).tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit over decreasing sizes: bin and offset of each item, and how full each bin is."""
    order = np.argsort(-sizes, kind="stable")
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n_bins = 0, 0  # bit r is set if a bin has room for just r more
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = open_ >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_ &= ~(1 << left)
        else:
            left, b = capacity, n_bins
            n_bins += 1
        number[i], offset[i] = b, capacity - left
        left -= size
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return number, offset, np.bincount(number, sizes, n_bins).astype(np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions, over all their parameters."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(count * x)))
    number = np.concatenate(([0], np.cumsum(count)))
    # over capacity - t: a whole bin; under t: nothing; between: its size
    t = np.arange(1, capacity // 2 + 1)
    large = number[capacity + 1] - number[capacity - t + 1]
    best = max(0, int((capacity * large + total[capacity - t + 1] - total[t]).max(initial=0)), int(total[-1]))
    bound = -(-best // capacity)
    # in k + 1 parts: whole multiples stay, others go down to the next multiple of 1 / k
    for k in range(1, 101):
        part = (k + 1) * x
        value = np.where(part % capacity == 0, x * k, part // capacity * capacity)
        bound = max(bound, -(-int((count * value).sum()) // (k * capacity)))
    return bound


def _pack(capacity: int, last: bool):
    """Packs a group; ``settled`` marks the pieces that keep their place."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, ignore_index=True)
        sizes = rows["length"].to_numpy()
        number, offset, full = best_fit(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        rows["bin"], rows["offset"] = number, offset
        rows["settled"] = True if last or len(full) == bound else full[number] == capacity
        rows["n_bins"], rows["lower_bound"] = len(full), bound
        return rows

    return run


def pieces_of(docs: DataFrame, tokenizer: str, end: int, drops_space: bool, length: int = LENGTH) -> DataFrame:
    prepared(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_cut(tokenizer, drops_space, end, length), _PIECES)


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset; also certified: whether the piece's group was proven to need its sequences."""
    workspace = Workspace(pieces.sparkSession)
    pieces = workspace.stage(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == length).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("__uid") + F.lit(1 << 62)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("certified"),
    )
    open_ = pieces.filter(F.col("length") < length)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, __uid long, __group long"
    done, round_, count = [whole], 0, open_.count()
    while count:
        groups = -(-count // group)
        dealt = open_.withColumn("__group", F.pmod(F.xxhash64("__uid", F.lit(round_)), F.lit(groups)))
        packed = workspace.stage(
            dealt.groupBy("__group").applyInPandas(
                _pack(length, groups == 1),
                f"{kinds}, bin long, offset long, settled boolean, n_bins long, lower_bound long",
            ),
            f"round{round_}",
        )
        left = packed.filter("not settled").count()
        last = count - left < SETTLED * count
        done.append(
            packed.filter(F.lit(last) | F.col("settled")).select(
                "doc_id",
                "piece",
                "start",
                "length",
                "ids_crc32",
                (F.lit(round_ << 54) + F.col("__group") * F.lit(1 << 30) + F.col("bin")).alias("sequence_id"),
                "offset",
                (F.col("n_bins") == F.col("lower_bound")).alias("certified"),
            )
        )
        open_ = packed.filter("not settled").select(*[c.split()[0] for c in kinds.split(", ")[:-1]])
        round_, count = round_ + 1, 0 if last else left
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(pieces_of(docs, tokenizer_path("word_bpe_49k.json"), end=0, drops_space=True))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_corpus(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of all documents that are left."""
    return packed_documents(docs)
