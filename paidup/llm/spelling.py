"""Spelling variants: words of a corpus that are one edit apart, found by pivotal grams.

Every word lists its bigrams from the rarest in the vocabulary on. Its gram prefix holds the first three;
among these, dynamic programming chooses the two disjoint ones (the pivots) that are rarest together. One
edit cannot touch both pivots, so of two near words the one whose prefix ends earlier in the order of the
grams has a pivot that stands, untouched, in the prefix of the other. The position limit is exact: an edit
to the right of the first pivot leaves everything up to this pivot as it is, and one to the left of the
second pivot leaves everything from there on. So a word looks up two keys for each of three lengths (the
part of the word up to the first pivot, the part from the second pivot on) among the like parts of
all words at their prefix grams; what meets is verified by edit distance.

The order of the grams is a table of at most 90 x 90 rows, whatever the corpus (26 letters and the 64
from U+00C0 to U+00FF). Keys that many words share are cut into cells of bounded size on both sides.

Null texts hold no words, and a null doc_id counts as an empty text in the checksum. Equal ids and
repeated rows count as often as they stand there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.llm.session import prepared
from paidup.llm.text import LOWER, blocks, span_hashes, utf8, word_spans
from paidup.workspace import Workspace

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A prefix of three bigrams always holds two disjoint ones.
PREFIX = 3
#: A pivot that is equal to the last gram of a prefix is one of its first five occurrences there: two
#: occurrences can stand before it in the word of the pivot, and one edit makes at most two more.
OCCURRENCES = 5
#: A word's form has at least so many times its occurrences.
RATIO = 2
#: One in so many runs loses a code point.
EVERY = 97
#: Words of one key that meet in one cell, on each side.
CELL = 2048
#: Different words that a task counts before it passes them on.
COUNTED = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[0xC3] = True
_EITHER = np.array([False, True])


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of letters a-z and U+00C0 to U+00FF (whose first byte is C3) in lower-cased UTF-8."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    return word_spans(inside.view(np.uint8), offsets, _EITHER)


def _shifted(sums: np.ndarray, size: int) -> np.ndarray:
    """What ``size`` more bytes of zero make of checksums: with these, crc32(a + b) is this of crc32(a) ^ crc32(b)."""
    zeros = bytes(size)
    still = zlib.crc32(zeros, 0)
    out = np.zeros(len(sums), np.uint32)
    for bit in range(32):
        step = np.uint32(zlib.crc32(zeros, 1 << bit) ^ still)
        out ^= np.where(sums >> np.uint32(bit) & np.uint32(1), step, np.uint32(0))
    return out


def _block_counts(ids: list, column: pa.Array) -> Iterator[tuple[str, int]]:
    """The words of a block of documents with their occurrences, after the deletions."""
    raw, offsets = utf8(column)
    data = LOWER[raw]
    starts, ends = letter_runs(data, offsets)
    if not len(starts):
        return
    _, example, word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    runs = [data[a:b].tobytes() for a, b in zip(starts[example].tolist(), ends[example].tolist())]
    sums = np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))
    texts = [x.decode() for x in runs]
    points = np.fromiter(map(len, texts), np.int64, len(runs))
    sizes, size = np.unique(ends[example] - starts[example], return_inverse=True)
    before = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids], np.uint32)
    shifted = np.stack([_shifted(before, int(x)) for x in sizes])
    document = np.searchsorted(offsets, starts, side="right") - 1
    h = shifted[size[word], document] ^ sums[word]
    cut = h % EVERY == 0
    whole = np.bincount(word[~cut], minlength=len(runs))
    for i in np.flatnonzero((whole > 0) & (points >= LEAST_LENGTH)).tolist():
        yield texts[i], int(whole[i])
    own = word[cut]
    for (i, at), n in Counter(zip(own.tolist(), (h[cut] % points[own]).tolist())).items():
        if points[i] > LEAST_LENGTH:
            yield texts[i][:at] + texts[i][at + 1 :], n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    total: Counter = Counter()
    for whole in batches:
        for batch in blocks(whole, "text"):
            for word, n in _block_counts(batch.column("doc_id").to_pylist(), batch.column("text")):
                total[word] += n
            if len(total) > COUNTED:
                yield rows()
                total.clear()
    yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts, with one in 97 runs shortened by a code point."""
    counted = docs.select("doc_id", "text").mapInArrow(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            total.update(map("".join, zip(word, word[1:])))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])


def pivots(places: list[int], cost: list[int]) -> tuple[int, int]:
    """The two disjoint places with the least cost together, the earlier first; dynamic programming
    over the places from left to right, with the cheapest that ends before the one at hand."""
    best, cheapest, waiting = None, None, 0
    for i, place in enumerate(places):
        while places[waiting] + 2 <= place:
            if cheapest is None or cost[waiting] < cost[cheapest]:
                cheapest = waiting
            waiting += 1
        if cheapest is not None:
            total = cost[cheapest] + cost[i]
            if best is None or total < best[0]:
                best = total, places[cheapest], place
    return best[1:]


def gram_prefix(ranks: list[int]) -> tuple[list[int], list[int], int]:
    """Places of the gram prefix, the places to be indexed, and the rank at which the prefix ends."""
    order = sorted(range(len(ranks)), key=lambda i: (ranks[i], i))
    prefix, last = order[:PREFIX], ranks[order[PREFIX - 1]]
    more, at = prefix.copy(), PREFIX
    room = OCCURRENCES - sum(ranks[i] == last for i in prefix)
    while room and at < len(order) and ranks[order[at]] == last:
        more.append(order[at])
        at, room = at + 1, room - 1
    return sorted(prefix), more, last


def _signatures(order: dict[str, tuple[int, int]]):
    """Per word the parts that it looks up, and the parts by which it is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, asked, filed = [], [], []
            for word in batch.column("word").to_pylist():
                grams = [order[a + b] for a, b in zip(word, word[1:])]
                prefix, places, last = gram_prefix([rank for rank, _ in grams])
                first, second = pivots(prefix, [grams[i][1] for i in prefix])
                ends.append(last)
                asked.append(["<" + word[: first + 2], ">" + word[second:]])
                filed.append([part for i in places for part in ("<" + word[: i + 2], ">" + word[i:])])
            parts = pa.list_(pa.string())
            columns = [batch.column("word"), batch.column("n"), pa.array(ends, pa.int64()), pa.array(asked, parts), pa.array(filed, parts)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "ends", "asked", "filed"])

    return run


def _dealt(rows: DataFrame, heavy: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of heavy keys get a piece of their own side and go to every piece of the other side."""
    pieces = {x: F.coalesce(F.ceil(F.col(f"n_{x}") / CELL), F.lit(1)).cast("int") for x in (own, other)}
    return (
        rows.join(heavy, "key", "left")
        .withColumn(own, F.pmod(F.xxhash64("word"), pieces[own]).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), pieces[other] - 1)))
        .drop("n_asked", "n_filed")
    )


def near_words(words: DataFrame, workspace: Workspace) -> DataFrame:
    """(a, a_n, b, b_n), a < b: all pairs of words (word, n) with an edit distance of one, each once."""
    counted = words.select("word").mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = counted.orderBy("n", "gram").collect()  # at most 90 x 90 rows
    order = {row["gram"]: (rank, row["n"]) for rank, row in enumerate(grams)}
    signed = words.mapInArrow(_signatures(order), "word string, n long, ends long, asked array<string>, filed array<string>")
    size = F.length("word")
    signed = workspace.stage(
        signed.select(
            "word",
            "n",
            "ends",
            F.flatten(
                F.transform("asked", lambda x: F.transform(F.array(size - 1, size, size + 1), lambda y: F.xxhash64(x, y)))
            ).alias("asked"),
            F.array_distinct(F.transform("filed", lambda x: F.xxhash64(x, size))).alias("filed"),
        ),
        "signatures",
    )
    asked = signed.select("word", "n", "ends", F.explode("asked").alias("key"))
    filed = signed.select("word", "n", "ends", F.explode("filed").alias("key"))
    sizes = asked.select("key", F.lit(1).alias("asked"), F.lit(0).alias("filed")).unionAll(
        filed.select("key", F.lit(0).alias("asked"), F.lit(1).alias("filed"))
    )
    sizes = sizes.groupBy("key").agg(F.sum("asked").alias("n_asked"), F.sum("filed").alias("n_filed"))
    most, least = F.greatest("n_asked", "n_filed"), F.least("n_asked", "n_filed")
    heavy = workspace.stage(sizes.filter((most > CELL) & (least > 0)), "heavy")
    cell = ["key", "asked", "filed"]
    left = _dealt(asked, heavy, "asked", "filed").select(*cell, F.col("word").alias("v"), F.col("n").alias("v_n"), F.col("ends").alias("v_ends"))
    right = _dealt(filed, heavy, "filed", "asked").select(*cell, F.col("word").alias("w"), F.col("n").alias("w_n"), F.col("ends").alias("w_ends"))
    met = left.join(right, cell).filter(
        (F.col("v_ends") <= F.col("w_ends")) & (F.col("v") != F.col("w")) & (F.levenshtein("v", "w", 1) == 1)
    )
    one, two = F.struct(F.col("v").alias("w"), F.col("v_n").alias("n")), F.struct("w", F.col("w_n").alias("n"))
    pairs = met.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    return pairs.select(F.col("a.w").alias("a"), F.col("a.n").alias("a_n"), F.col("b.w").alias("b"), F.col("b.n").alias("b_n"))


def _roots(forms: DataFrame, workspace: Workspace) -> DataFrame:
    """(word, root): where the chain of forms ends. A form occurs at least twice as often as its word, so
    chains are short and have no cycles; each round doubles the steps that a word has taken."""
    now = workspace.stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = workspace.stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    workspace = Workspace(prepared(docs.sparkSession, 4096))
    words = workspace.stage(vocabulary(docs), "words")
    pairs = near_words(words, workspace)
    sides = [F.struct(F.col(w).alias("word"), F.col(x).alias("near"), F.col(f"{x}_n").alias("near_n")) for w, x in ("ab", "ba")]
    best = pairs.select(F.inline(F.array(*sides))).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    near = workspace.stage(words.join(best, "word", "left"), "near")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    near = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    roots = _roots(near.filter("form is not null"), workspace)
    return near.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("string"))
    return spelling_groups(docs).select("word", "form", "root", "n", "n_near", "form_n")
