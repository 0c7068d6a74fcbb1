"""Token ids in binary files of patched frame-of-reference blocks.

A file holds documents in ascending order of doc_id. Ids are cut into blocks of ``BLOCK``. A block
keeps its minimum, the ids less the minimum packed at a width that ``SHARE`` of them fit into, and
the others whole in a list of exceptions with their places. Behind the blocks stand the index of the
block starts and the table of documents, so a reader can start at any block or document.

    "PFOR" version | blocks | block starts u64 | doc ids i64 | null flags u8 | token counts u32 | footer

Null texts are empty documents (the end id alone). A null doc_id comes before all others and is kept
as null. Rows with one doc_id stay apart, ordered by the hash of their texts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paidup.llm.files import created, new_folder, opened
from paidup.llm.pieces import encoder, tokenizer_path, with_end
from paidup.llm.session import prepared
from paidup.llm.text import blocks
from paidup.workspace import Workspace

MAGIC = b"PFOR\x01\x00\x00\x00"
BLOCK = 4096
SHARE = 0.95
#: Ids in a file, after which a task begins another one.
FILE_IDS = 32 << 20

_HEAD = struct.Struct("<IIBH")  # ids, minimum, width, exceptions
_FOOT = struct.Struct("<QQQ")  # blocks, documents, ids


def packed(ids: np.ndarray) -> bytes:
    """One block."""
    low = int(ids.min())
    rest = ids - np.uint32(low)
    width = int(np.partition(rest, int(SHARE * (len(rest) - 1)))[int(SHARE * (len(rest) - 1))]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = ((rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return b"".join(
        (
            _HEAD.pack(len(ids), low, width, len(odd)),
            np.packbits(bits.ravel(), bitorder="little").tobytes(),
            odd.astype("<u2").tobytes(),
            rest[odd].astype("<u4").tobytes(),
        )
    )


def unpacked(block: bytes) -> np.ndarray:
    n, low, width, n_odd = _HEAD.unpack_from(block)
    end = _HEAD.size + (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(block[_HEAD.size : end], np.uint8), count=n * width, bitorder="little")
    ids = np.zeros(n, np.uint32)
    for k, column in enumerate(bits.reshape(n, width).T):
        ids |= column.astype(np.uint32) << np.uint32(k)
    odd = np.frombuffer(block, "<u2", n_odd, end)
    ids[odd] = np.frombuffer(block, "<u4", n_odd, end + 2 * n_odd)
    return ids + np.uint32(low)


class Writer:
    def __init__(self, folder: str):
        self.out, self.path = created(folder, ".pfor")
        self.out.write(MAGIC)
        self.at, self.starts, self.docs, self.counts = len(MAGIC), [], [], []
        self.rest: list[np.ndarray] = []
        self.waiting = self.n_ids = 0

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts.append(counts)
        self.rest.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        end = len(ids) if all_ else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            block = packed(ids[i : min(i + BLOCK, end)])
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.rest, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        none = [x is None for x in self.docs]
        for part in (
            np.array([*self.starts, self.at], "<u8"),
            np.array([0 if x is None else x for x in self.docs], "<i8"),
            np.array(none, "u1"),
            np.concatenate([*self.counts, np.zeros(0, np.int64)]).astype("<u4"),
        ):
            self.out.write(part.tobytes())
        self.out.write(_FOOT.pack(len(self.starts), len(self.docs), self.n_ids))
        self.out.close()


def read(path: str, blocks_at_once: int = 256) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids or None, token counts) of the whole file come first with no ids; then the ids, some blocks at a time."""
    with opened(path) as file:
        size = file.size()
        if file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no such file")
        n_blocks, n_docs, _ = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
        tail = 8 * (n_blocks + 1) + 13 * n_docs
        table = file.read_at(tail, size - _FOOT.size - tail)
        starts = np.frombuffer(table, "<u8", n_blocks + 1).astype(np.int64)
        doc_ids = np.frombuffer(table, "<i8", n_docs, 8 * (n_blocks + 1))
        none = np.frombuffer(table, "u1", n_docs, 8 * (n_blocks + 1 + n_docs))
        counts = np.frombuffer(table, "<u4", n_docs, 8 * (n_blocks + 1 + n_docs) + n_docs).astype(np.int64)
        yield [None if n else d for d, n in zip(doc_ids.tolist(), none)], counts, np.zeros(0, np.uint32)
        for k in range(0, n_blocks, blocks_at_once):
            end = min(k + blocks_at_once, n_blocks)
            data = file.read_at(int(starts[end] - starts[k]), int(starts[k]))
            ids = [unpacked(data[starts[i] - starts[k] : starts[i + 1] - starts[k]]) for i in range(k, end)]
            yield [], counts[:0], np.concatenate(ids)


def _write(folder: str, path: str, drops_space: bool, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, writer = TaskContext.get().partitionId(), [], None
        for whole in batches:
            for batch in blocks(whole, "text"):
                if writer is None:
                    writer = Writer(folder)
                ids, counts = encoder(path, drops_space).encode(batch.column("text"))
                ids, bounds = with_end(ids, counts, end)
                writer.add(batch.column("doc_id").to_pylist(), ids, np.diff(bounds))
                if writer.n_ids >= file_ids:
                    writer.close()
                    rows.append((part, len(rows), writer.path, len(writer.docs), writer.n_ids))
                    writer = None
        if writer is not None:
            writer.close()
            rows.append((part, len(rows), writer.path, len(writer.docs), writer.n_ids))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[k] for r in rows], kind)
                for k, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))
            ],
            ["part", "number", "path", "n_docs", "n_ids"],
        )

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, end: int, drops_space: bool = False, file_ids: int = FILE_IDS
) -> DataFrame:
    """Writes the files and returns a row for each, with ``start``: the ids in the files before it."""
    spark = prepared(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("__tie", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")
    written = ordered.mapInArrow(
        _write(new_folder(spark, "tokens"), tokenizer, drops_space, end, file_ids),
        "part int, number int, path string, n_docs long, n_ids long",
    )
    files = Workspace(spark).stage(written, "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            parts = read(path)
            doc_ids, counts, _ = next(parts)
            bounds = np.concatenate(([0], np.cumsum(counts)))
            crc = np.zeros(len(doc_ids), np.int64)
            at, doc = 0, 0
            for _, _, ids in parts:
                data, end = ids.astype("<u4").tobytes(), at + len(ids)
                while doc < len(doc_ids) and bounds[doc] < end:
                    a, b = max(int(bounds[doc]), at) - at, min(int(bounds[doc + 1]), end) - at
                    crc[doc] = zlib.crc32(data[4 * a : 4 * b], int(crc[doc]))
                    if bounds[doc + 1] > end:
                        break
                    doc += 1
                at = end
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(bounds[:-1] + start, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end=2)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for is not coalesced
    return files.select("path", "start").repartition(tasks, "path").mapInArrow(
        _read_back, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
