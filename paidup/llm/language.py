"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2-, 3- and 4-byte pieces of the text with A-Z in lower case and everything in ASCII
that is no letter read as one space. Their hashes pick embeddings; a text is the mean of its
embeddings. Embeddings and softmax are trained by stochastic gradient descent in numpy on the driver,
on at most ``PER_LANGUAGE`` labelled texts of each language, the ones with the smallest hashes; the
tasks turn these texts into hashed counts, so what reaches the driver is bounded for texts of any
length. A part of the sample is kept from training to fit the temperature of the softmax, for slightly smoothed
targets, so that texts that are all told apart do not make it sure of everything.

A prediction is rejected if its score is low, or if the text is strange: the share of its subwords that the model
was trained on (the familiarity) is low, as it is in languages nobody taught it. Both floors come from all labelled documents that are
not held out and are predicted rightly: the quantile ``REJECTED`` of each, lowered by ``SLACK`` for the familiarity and never above ``SURE``
for the score.

A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could
be learned. A null doc_id counts as held out. Rows repeat as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paidup.llm.session import prepared
from paidup.llm.text import LOWER, blocks, utf8

#: Most labelled texts of a language that the model is fitted on.
PER_LANGUAGE = 400
#: Parts that a language is ranked in first.
SHARES = 64
#: Buckets of the hash, width of an embedding.
BUCKETS, WIDTH = 1 << 16, 16
EPOCHS, BATCH, RATE = 6, 16, 2.0
#: Share of the rightly predicted documents below the floors before they are lowered, the score above which none is
#: rejected for its score, and what the floor of the familiarity is lowered to.
REJECTED, SURE, SLACK = 0.001, 0.6, 0.9

_FOLD = LOWER.copy()
_FOLD[:128][~np.isin(np.arange(128), np.r_[65:91, 97:123])] = 32
_SALT = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}


def subwords(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size of subword: the bucket at each byte, and the bounds of the texts; texts are padded by spaces."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    data = np.full(len(raw) + 4 * n, 32, np.uint8)
    data[np.arange(len(raw)) + np.repeat(4 * np.arange(n), np.diff(offsets))] = _FOLD[raw]
    bounds = offsets + 4 * np.arange(n + 1)
    space = data == 32
    kept = ~space
    kept[1:] |= ~space[:-1]
    kept[bounds[:-1]] = True
    data = data[kept]
    bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
    value = data.astype(np.uint32)
    for size in (2, 3, 4):
        grown = np.zeros(len(data), np.uint32)
        grown[: len(data) - size + 1] = data[size - 1 :]
        value = (value << np.uint32(8)) | grown
        h = (value ^ (value >> np.uint32(15))) * _SALT[size]
        yield (h >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int32), bounds


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in blocks(whole, "text"):
            parts = list(subwords(batch.column("text")))
            buckets, weights = [], []
            for t in range(len(batch)):
                own = np.concatenate([h[b[t] : b[t + 1]] for h, b in parts])
                bucket, count = np.unique(own, return_counts=True)
                buckets.append(bucket.astype(np.int32))
                weights.append((count / max(len(own), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    pa.array([x.tobytes() for x in buckets], pa.binary()),
                    pa.array([x.tobytes() for x in weights], pa.binary()),
                ],
                ["lang", "buckets", "weights"],
            )


class Model:
    """``table[bucket]`` holds what a subword adds to the score of each language, and last whether it was trained on."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature
        #: Floors of the score and of the familiarity.
        self.reject, self.strange = 0.0, 0.0

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The logits of each text, and its familiarity."""
        out, sizes = np.zeros((len(column), len(self.languages) + 1)), np.zeros(len(column))
        for h, bounds in subwords(column):
            out += np.add.reduceat(self.table[h], bounds[:-1], axis=0, dtype=np.float64)
            sizes += np.diff(bounds)
        out /= sizes[:, None]
        return out[:, :-1] + self.bias, out[:, -1]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def trained(rows: list) -> Model | None:
    """Fits embeddings and softmax to rows of (lang, buckets, weights), in the order given."""
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    random = np.random.default_rng(11)
    label = np.array([languages.index(r.lang) for r in rows])
    buckets = [np.frombuffer(r.buckets, np.int32) for r in rows]
    weights = [np.frombuffer(r.weights, np.float32) for r in rows]
    apart = random.permutation(len(rows))
    held, own = apart[: len(rows) // 5], apart[len(rows) // 5 :]
    embedding = random.normal(0, 0.1, (BUCKETS, WIDTH))
    softmax = random.normal(0, 0.1, (WIDTH, len(languages)))
    bias = np.zeros(len(languages))
    share = 1 / np.maximum(np.bincount(label[own], minlength=len(languages)), 1)
    share *= len(own) / len(languages)

    def gathered(some: np.ndarray):
        sizes = np.array([len(buckets[i]) for i in some])
        at = np.concatenate([buckets[i] for i in some])
        weight = np.concatenate([weights[i] for i in some])[:, None]
        return at, weight, np.repeat(np.arange(len(some)), sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(own)
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            at, weight, text, edges = gathered(some)
            mean = np.add.reduceat(embedding[at] * weight, edges, axis=0)
            error = _softmax(mean @ softmax + bias)
            error[np.arange(len(some)), label[some]] -= 1
            error *= share[label[some]][:, None] / len(some)
            back = (error @ softmax.T) * len(some)
            softmax -= rate * mean.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            # a text spreads its gradient over many embeddings, each by its small weight
            change = back[text] * weight * (30 * rate)
            for d in range(WIDTH):
                embedding[:, d] -= np.bincount(at, change[:, d], BUCKETS)
    table = embedding @ softmax
    if not len(held):
        held = own
    logits = np.stack([(table[buckets[i]] * weights[i][:, None]).sum(axis=0) + bias for i in held])
    right = np.arange(len(held)), label[held]
    choices = np.geomspace(0.005, 20, 91)
    smooth = np.full(logits.shape, 1 / (len(held) + 2) / max(len(languages) - 1, 1))
    smooth[right] = 1 - 1 / (len(held) + 2)
    loss = [-(smooth * np.log(np.maximum(_softmax(logits / t), 1e-30))).sum(axis=1).mean() for t in choices]
    temperature = float(choices[int(np.argmin(loss))])
    seen = np.bincount(np.concatenate([buckets[i] for i in own]), minlength=BUCKETS) > 0
    return Model(languages, np.column_stack((table, seen)).astype(np.float32), bias, temperature)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _first(rows: DataFrame, keys: list[str], order, most: int) -> DataFrame:
    """The first ``most`` rows of every key; with ``share`` among the keys, of every share of a language.

    A share is the rows of some tasks. The first texts of a language are among those of its shares, however these
    fall, so the one task of a language reads at most ``SHARES * most`` texts, whatever the number of documents.
    Every task sends at most ``most`` texts of a language.
    """
    rows = rows.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= most).select("doc_id", "text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from labelled documents that are not held out, at most ``per_language`` of each language."""
    prepared(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    order = F.xxhash64(F.col("doc_id"), F.lit(5)), F.col("doc_id"), F.xxhash64("text")
    chosen = own.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counted = _first(_first(chosen, ["lang", "share"], order, per_language), ["lang"], order, per_language)
    rows = counted.mapInArrow(_counts, "lang string, buckets binary, weights binary").collect()
    model = trained(sorted(rows, key=lambda r: (r.lang, bytes(r.buckets), bytes(r.weights))))
    if model:
        known = chosen.select("doc_id", "text", "lang").mapInArrow(
            _known(docs.sparkSession.sparkContext.broadcast(model)), "score double, familiar double"
        )
        floors = known.agg(*[F.percentile_approx(c, REJECTED, 100_000) for c in ("score", "familiar")]).first()
        model.reject, model.strange = min(SURE, floors[0] or 0.0), SLACK * (floors[1] or 0.0)
    return model


def _letterless(batch: pa.RecordBatch) -> np.ndarray:
    """Which texts are null or have no letter."""
    raw, offsets = utf8(batch.column("text"))
    ascii_ = np.concatenate(([0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))))
    none = np.diff(ascii_[offsets]) == 0
    for t in np.flatnonzero(none & (np.diff(offsets) > 0)).tolist():
        none[t] = not any(c.isalpha() for c in raw[offsets[t] : offsets[t + 1]].tobytes().decode())
    return none


def _scored(batch: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: und), calibrated score, and whether the prediction is rejected."""
    none = _letterless(batch)
    if model is None:
        return np.full(len(batch), -1), np.zeros(len(batch)), np.ones(len(batch), bool)
    logits, familiar = model.read(batch.column("text"))
    p = model.probabilities(logits)
    best, score = p.argmax(axis=1), p.max(axis=1)
    best[none], score[none] = -1, 0.0
    return best, score, none | (score < model.reject) | (familiar < model.strange)


def _known(shared):
    """Score and familiarity of the texts whose language is predicted rightly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                logits, familiar = shared.value.read(batch.column("text"))
                p = shared.value.probabilities(logits)
                names = np.array(shared.value.languages, dtype=object)[p.argmax(axis=1)]
                right = names == np.array(batch.column("lang").to_pylist(), dtype=object)
                yield pa.RecordBatch.from_arrays([pa.array(p.max(axis=1)[right]), pa.array(familiar[right])], ["score", "familiar"])

    return run


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(shared.value.languages if shared.value else []), "und"], dtype=object)
        for whole in batches:
            for batch in blocks(whole, "text"):
                best, score, rejected = _scored(batch, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(names[best].tolist(), pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(rejected),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"],
                )

    return run


def _accepted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                yield batch.filter(pa.array(~_scored(batch, shared.value)[2]))

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    spark = prepared(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(
        _predict(spark.sparkContext.broadcast(model)),
        "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean",
    )


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))


def with_known_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go (no letter, or a score or familiarity below the fitted floors)."""
    model = fit(docs)
    return docs.mapInArrow(_accepted(spark.sparkContext.broadcast(model)), docs.schema)
