"""Benchmark decontamination with an FM-index per shard of documents.

Every block of documents that a task reads is a shard. Its words become symbols (words that no
phrase holds separate the runs, as no phrase can cross them), the shard is indexed, all phrases are
searched backward through wavelet-tree ranks, and sampled suffix positions give the places. There
is no shuffle: a shard needs only the phrases, which go to the tasks in pieces of bounded size.

Words are compared by 64-bit hashes. Null texts have no words and null item ids name nothing.
Repeated documents give a row each; items with one id count once. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.llm.fm_index import FmIndex
from paidup.llm.session import prepared
from paidup.llm.text import Words, blocks

#: Words in a window.
WINDOW = 13
#: Largest total of benchmark text, in bytes, that one pass carries to the tasks.
PHRASE_BYTES = 4 << 20

_FOUND = "doc_id long, n_words long, n_hit long, item_ids array<long>, hit_spans array<struct<start:int,end:int>>"


class Phrases:
    """Windows of the benchmark items as rows of symbols, by length, with the items of each window."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        words = Words(pa.array([text for _, text in items], pa.string()))
        self.vocabulary = np.unique(words.hashes)
        symbols = np.searchsorted(self.vocabulary, words.hashes) + 1
        rows: dict[bytes, list[int]] = {}
        for (item, _), begin, end in zip(items, words.bounds, words.bounds[1:]):
            size = min(window, end - begin)
            for i in range(begin, end - size + 1 if size else begin):
                rows.setdefault(symbols[i : i + size].astype(np.int64).tobytes(), []).append(item)
        self.groups = []
        for size in sorted({len(k) for k in rows}):
            keys = [k for k in rows if len(k) == size]
            owners = [sorted(set(rows[k])) for k in keys]
            self.groups.append(
                (
                    np.frombuffer(b"".join(keys), np.int64).reshape(len(keys), size // 8),
                    np.concatenate(([0], np.cumsum([len(x) for x in owners]))),
                    np.array([x for own in owners for x in own], np.int64),
                )
            )
        self.least = min((g[0].shape[1] for g in self.groups), default=1)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbol of each word, 0 for a word of no phrase."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _runs(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the stretches that are long enough for a phrase, a 0 before each, and their word numbers."""
    symbols = phrases.symbols(words.hashes)
    known = symbols > 0
    begins, ends = known.copy(), known.copy()
    begins[1:] &= ~known[:-1]
    ends[:-1] &= ~known[1:]
    cuts = words.bounds[(words.bounds > 0) & (words.bounds < len(known))]
    begins[cuts] = known[cuts]
    ends[cuts - 1] = known[cuts - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = ends - begins >= phrases.least
    begins, sizes = begins[long], (ends - begins)[long] + 1
    edges = np.concatenate(([0], np.cumsum(sizes)))
    number = np.arange(edges[-1]) + np.repeat(begins - 1 - edges[:-1], sizes)
    out = symbols[np.maximum(number, 0)]
    out[edges[:-1]] = 0
    return np.concatenate((out, [0])), np.concatenate((number, [-1]))


def shard_hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of the shard are hit, and the (text, item) pairs found."""
    hit = np.zeros(len(words.hashes) + 1, np.int64)
    texts, items = [], []
    symbols, number = _runs(words, phrases)
    if len(symbols) > 1:
        index = FmIndex(symbols, len(phrases.vocabulary) + 1)
        for rows, owner_bounds, owners in phrases.groups:
            phrase, position = index.locate(*index.ranges(rows))
            start = number[position]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + rows.shape[1], -1)
            pair = np.unique(words.text_of(start) * len(rows) + phrase)
            text, phrase = pair // len(rows), pair % len(rows)
            n = owner_bounds[phrase + 1] - owner_bounds[phrase]
            at = np.arange(int(n.sum())) + np.repeat(owner_bounds[phrase] - np.concatenate(([0], np.cumsum(n)[:-1]))[: len(n)], n)
            texts.append(np.repeat(text, n))
            items.append(owners[at])
    empty = np.zeros(0, np.int64)
    return np.cumsum(hit[:-1]) > 0, np.concatenate([*texts, empty]), np.concatenate([*items, empty])


def _shards(batches: Iterator[pa.RecordBatch], pieces: list) -> Iterator[tuple]:
    """Per block of documents: the rows, their words, which words are hit, and the items found in each text."""
    for whole in batches:
        for batch in blocks(whole, "text"):
            words = Words(batch.column("text"))
            hit = np.zeros(len(words.hashes), bool)
            found: list[set] = [set() for _ in range(len(batch))]
            for piece in pieces:
                own, texts, items = shard_hits(words, piece.value)
                hit |= own
                for t, i in zip(texts.tolist(), items.tolist()):
                    found[t].add(i)
            total = np.concatenate(([0], np.cumsum(hit)))
            yield batch, words, hit, total[words.bounds[1:]] - total[words.bounds[:-1]], found


def _search(pieces: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, hit, n_hit, found in _shards(batches, pieces):
            spans = [[] for _ in range(len(batch))]
            for t in np.flatnonzero(n_hit).tolist():
                own = np.concatenate(([0], hit[words.bounds[t] : words.bounds[t + 1]].astype(np.int8), [0]))
                turn = np.flatnonzero(np.diff(own))
                spans[t] = [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(words.counts, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.int64())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["doc_id", "n_words", "n_hit", "item_ids", "hit_spans"],
            )

    return run


def _clean(pieces: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, _, n_hit, _ in _shards(batches, pieces):
            yield batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= words.counts))))

    return run


def phrase_pieces(benchmark: DataFrame, window: int = WINDOW, limit: int = PHRASE_BYTES) -> list:
    """The phrases as broadcasts of at most ``limit`` bytes of benchmark text each (or one item).

    Items are read partition by partition; neither the driver nor a task needs more than a piece at a time.
    """
    spark = benchmark.sparkSession
    own = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(
        "item_id is not null and text is not null"
    )
    pieces, items, total = [], [], 0
    for row in own.toLocalIterator():
        size = len(row.text.encode())
        if items and total + size > limit:
            pieces.append(spark.sparkContext.broadcast(Phrases(items, window)))
            items, total = [], 0
        items.append((row.item_id, row.text))
        total += size
    return [*pieces, spark.sparkContext.broadcast(Phrases(items, window))]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (found items) and hit_spans (merged spans of hit words)."""
    prepared(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_search(phrase_pieces(benchmark, window, phrase_bytes)), _FOUND)


def contaminated():
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.array_join(F.transform("hit_spans", lambda s: F.concat_ws(":", s.start, s.end)), ",").alias("hit_spans"),
    )


def without_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the contamination rule meets go, all others stay as they are."""
    prepared(spark)
    pieces = phrase_pieces(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.mapInArrow(_clean(pieces), docs.schema)
