"""Vector codes: every part of a vector becomes the index of its nearest entry in the codebook of the part.

Components become integers (floor of ``SCALE`` times the value). The vectors are written once, as blocks:
per dimension a dictionary of the different integers of the block, and per vector the code of its
integer in each dictionary. A pass over the blocks tabulates, for every dimension, the squared difference
of every dictionary value to all entries; the distance of a part to all entries is then a gather by code and an
add per dimension, however many vectors share a value. Passes only send sums: ``entries x dimensions``
numbers and as many counts a task, so nothing that grows with the table reaches the driver.

All arithmetic is in integers. Vectors that are null, empty or hold null or non-finite components
are left out; so are those of another length than the one with the smallest id, and those with components so
large (about 32,000 in 64 dimensions) that a long could not hold their squared distances. If the length is not a multiple of
the number of parts, the parts are cut at ``length * part // parts``. Rows that repeat an id are rows like any others; a
null id comes after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paidup.llm.session import prepared
from paidup.workspace import Workspace

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bound of the largest scaled component times the root of the length: squared distances stay below 2 ** 62.
LARGEST = 1 << 30
#: Components of a block, about.
BLOCK = 1 << 18


def usable(vector: str) -> Column:
    """Not null, not empty, and of finite components only, none of them too large."""
    limit = F.lit(LARGEST / SCALE) / F.sqrt(F.size(vector))
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x).cast("double") < limit))
    return F.coalesce((F.size(vector) > 0) & fits, F.lit(False))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (row ids, labels, dictionary sizes, dictionaries, codes), each an array of bytes."""
    for whole in batches:
        width = len(whole.column("vector")[0]) if len(whole) else 1
        for first in range(0, len(whole), max(BLOCK // width, 1)):
            batch = whole.slice(first, max(BLOCK // width, 1))
            values = pc.list_flatten(batch.column("vector")).to_numpy(zero_copy_only=False).astype(np.float64)
            integers = np.floor(values * SCALE).astype(np.int64).reshape(len(batch), width)
            found = [np.unique(x, return_inverse=True) for x in integers.T]
            sink = pa.BufferOutputStream()
            rows = batch.select(["vec_id", "label"])
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    pa.array([np.array([len(x) for x, _ in found]).tobytes()], pa.binary()),
                    pa.array([np.concatenate([x for x, _ in found]).tobytes()], pa.binary()),
                    pa.array([np.stack([x for _, x in found]).astype(np.uint32).tobytes()], pa.binary()),
                ],
                ["rows", "sizes", "dictionary", "codes"],
            )


class Block:
    """The dictionaries and codes of a block of vectors."""

    def __init__(self, row: dict):
        sizes = np.frombuffer(row["sizes"], np.int64)
        self.dictionaries = np.split(np.frombuffer(row["dictionary"], np.int64), np.cumsum(sizes)[:-1])
        self.codes = np.frombuffer(row["codes"], np.uint32).reshape(len(sizes), -1)

    def distances(self, dimensions: range, entries: np.ndarray) -> np.ndarray:
        """Squared distances of the part to every entry: (vector, entry)."""
        total = np.zeros((self.codes.shape[1], len(entries)), np.int64)
        for i, d in enumerate(dimensions):
            table = (self.dictionaries[d][:, None] - entries[None, :, i]) ** 2
            total += table[self.codes[d]]
        return total

    def sums(self, dimensions: range, choice: np.ndarray, entries: int) -> np.ndarray:
        """Per entry the sum of each component of the parts that chose it: counted by code, then weighed."""
        out = np.zeros((entries, len(dimensions)), np.int64)
        for i, d in enumerate(dimensions):
            size = len(self.dictionaries[d])
            often = np.bincount(choice * size + self.codes[d], minlength=entries * size).reshape(entries, size)
            out[:, i] = often @ self.dictionaries[d]
        return out


Codebooks = list[np.ndarray]


def part_dimensions(width: int, parts: int) -> list[range]:
    return [range(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


def _assign(books: Codebooks):
    """A task's sums: (part, entry, count and sum of each component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = part_dimensions(sum(x.shape[1] for x in books), len(books))
        count = [np.zeros(len(x), np.int64) for x in books]
        total = [np.zeros(x.shape, np.int64) for x in books]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for p, own in enumerate(parts):
                    choice = block.distances(own, books[p]).argmin(axis=1)
                    count[p] += np.bincount(choice, minlength=len(books[p]))
                    total[p] += block.sums(own, choice, len(books[p]))
        out = [(p, e, 0, int(count[p][e])) for p in range(len(books)) for e in range(len(books[p]))]
        out += [(p, e, 1 + i, int(x)) for p in range(len(books)) for e, own in enumerate(total[p]) for i, x in enumerate(own)]
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "item", "total"])

    return run


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = part_dimensions(sum(x.shape[1] for x in books), len(books))
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                with pa.ipc.open_stream(row["rows"]) as stream:
                    rows = stream.read_next_batch()
                chosen, error = np.zeros((len(rows), len(books)), np.uint8), np.zeros(len(rows), np.int64)
                for p, own in enumerate(parts):
                    distance = block.distances(own, books[p])
                    choice = distance.argmin(axis=1)
                    chosen[:, p] = choice
                    error += distance[np.arange(len(rows)), choice]
                code = pa.array([x.tobytes().hex() for x in chosen])
                yield pa.RecordBatch.from_arrays([*rows.columns, code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


class VectorCodes:
    """Codebooks trained on all vectors of a table (vec_id, label, vector), and the codes of the vectors.

    ``entries`` is at most 256. The codebooks start from the parts of the smallest ids; an entry that no part chose
    stays as it is.
    """

    def __init__(self, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
        spark = prepared(vectors.sparkSession, 4096)
        self.workspace = Workspace(spark)
        kept = vectors.filter(usable("vector"))
        first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
        self.width = len(first[0]["vector"]) if first else 0
        start = [x["vector"] for x in first if len(x["vector"]) == self.width]
        integers = np.floor(np.array(start, np.float64).reshape(len(start), self.width) * SCALE).astype(np.int64)
        self.books = [integers[:, own.start : own.stop] for own in part_dimensions(self.width, parts)]
        self.label_type = vectors.schema["label"].dataType
        self.id_type = vectors.schema["vec_id"].dataType
        kept = kept.filter(F.size("vector") == self.width).select("vec_id", "label", F.col("vector").cast("array<double>"))
        self.blocks = self.workspace.stage(
            kept.mapInArrow(_encode, "rows binary, sizes binary, dictionary binary, codes binary"), "blocks"
        )
        for _ in range(rounds if start else 0):
            self._round()

    def _round(self) -> None:
        """Every entry becomes the floor of the mean of the parts that are nearest to it."""
        sums = self.blocks.drop("rows").mapInArrow(_assign(self.books), "part long, entry long, item long, total long")
        sums = sums.groupBy("part", "entry", "item").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {(r["part"], r["entry"], r["item"]): int(r["total"]) for r in sums.collect()}  # entries x (dimensions + parts)
        for p, book in enumerate(self.books):
            new = book.copy()
            for e in range(len(book)):
                if n := found.get((p, e, 0), 0):
                    new[e] = [found[p, e, 1 + i] // n for i in range(book.shape[1])]
            self.books[p] = new

    def digest(self) -> str:
        """SHA-256 of the integers of the codebooks by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """(vec_id, label, code, error): two hex digits a part, and the squared distance to the coded vector."""
        schema = f"vec_id {self.id_type.simpleString()}, label {self.label_type.simpleString()}, code string, error long"
        if not self.width:
            return self.blocks.sparkSession.createDataFrame([], schema)
        return self.blocks.mapInArrow(_codes(self.books), schema)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("vector"))
    coder = VectorCodes(vectors)
    codes = coder.workspace.stage(coder.codes(), "codes")
    # rows that share a label meet its sum, not each other
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "own")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("own")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(coder.digest()).alias("codebooks_sha256")
    )
