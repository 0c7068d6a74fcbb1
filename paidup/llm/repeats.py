"""Exact removal of repeated byte strings by an enhanced suffix array, built where repeats can be.

A byte goes if a string of ``LEAST`` bytes that covers it also starts earlier (in a document with a
smaller id, or earlier in the same one). Documents are gathered into chunks of a few megabytes, which
are written once and then only exchange small messages:

1. Each string of ``LEAST`` bytes has a key, the smallest hash of the ``GRAM``-byte pieces in it. Strings
   that start side by side mostly share it: such a stretch is a run. Chunks send the different keys of
   their runs (about one for 35 bytes), packed, to the bucket of the key; the bucket replies which keys
   occur more than once. All other runs hold no repeat.
2. Chunks send the bytes of the runs that are left, each different run once, to the bucket of the key.
   All equal strings have one key, so each bucket is a suffix array of its own: the suffixes that
   begin in its runs are ordered, and a stack scan over their common-prefix interval tree gives the
   maximal repeats with all occurrences. The earliest occurrence stays, the others are spans to remove.
   A key with over ``HOT`` occurrences is split: each of its strings goes to the bucket of its own hash.
3. Chunks get the spans back, merge them and cut.

Runs and strings are told apart by two 64-bit hashes of all their bytes; strings that a bucket finds equal are equal
byte for byte. Null texts are empty. A null doc_id counts as the smallest, and rows with one doc_id
are ordered by their place in the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.llm.session import prepared, release_memory
from paidup.llm.suffix_array import EnhancedSuffixArray
from paidup.llm.text import _BYTE, _STEP, blocks, mixed, utf8
from paidup.workspace import Workspace

LEAST, GRAM = 100, 32
WINDOW = LEAST - GRAM + 1
#: Occurrences of a key beyond which its strings are dealt out one by one.
HOT = 50_000
#: Bytes of documents for one bucket of keys, and for one bucket of runs.
KEY_BYTES, RUN_BYTES = 16 << 20, 8 << 20
#: Bytes of a chunk whose runs are found in one go, and parts of a bucket that are worked on in turn.
SLICE, SHARES = 1 << 18, 8

_NONE = np.iinfo(np.int64).min
_KEY = np.uint64(0x2545F4914F6CDD1D)


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    release_memory()
    for whole in batches:
        for batch in blocks(whole, "text"):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            size = int(utf8(batch.column("text"))[1][-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                ],
                ["chunk", "size", "rows"],
            )
            number += 1


def _rows(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as stream:
        return stream.read_next_batch()


class Slice:
    """A stretch of a chunk: the strings that start in places ``begin`` to ``end``, with the arrays to find its runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begin: int, end: int):
        self.begin = begin
        self.by_size = _rolling(data[begin : end + LEAST - 1])
        self.grams = mixed(self.by_size[GRAM])
        self.least = _sliding(np.minimum, self.grams)
        first, last = (int(np.searchsorted(offsets, x, side="right")) - 1 for x in (begin, end - 1))
        self.text = np.repeat(np.arange(first, last + 1), np.diff(offsets[first : last + 2].clip(begin, end)))
        #: Strings that do not go beyond their text.
        self.whole = np.arange(begin + LEAST, end + LEAST) <= offsets[self.text + 1]

    def runs(self) -> tuple[np.ndarray, ...]:
        """Start, count and key of the runs, and the hashes of the first and the last string of each."""
        begin = self.whole.copy()
        begin[1:] &= (self.least[1:] != self.least[:-1]) | (self.text[1:] != self.text[:-1])
        start = np.flatnonzero(begin)
        last = self.whole.copy()
        last[:-1] &= begin[1:] | ~self.whole[1:]
        count = np.flatnonzero(last) + 1 - start
        # long runs (periodic text) are cut, so that the strings at both ends cover a run
        pieces = -(-count // WINDOW)
        number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + number * WINDOW
        count = np.minimum(WINDOW, np.repeat(count, pieces) - number * WINDOW)
        ends = (_strings(self.by_size, at) for at in (start, start + count - 1))
        return start + self.begin, count, mixed(self.least[start] + _KEY), *ends

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The different keys, and how many pieces have each: two of a key in one run make it repeated, too."""
        edge = np.zeros(WINDOW - 1, np.uint64)
        least = np.where(self.whole, self.least, np.uint64(0))
        chosen = self.grams == _sliding(np.maximum, np.concatenate((edge, least, edge)))
        return np.unique(mixed(self.grams[chosen] + _KEY), return_counts=True)


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[Slice]:
    """One at a time: a slice takes some seventy bytes a byte of text, a chunk only those of its runs. A run that a slice cuts
    is two runs with one key, and a piece near a cut may count twice, which costs a message and changes nothing."""
    n = len(data) - LEAST + 1
    for begin in range(0, n, SLICE):
        yield Slice(data, offsets, begin, min(begin + SLICE, n))


def key_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of a chunk and how many pieces have each."""
    found = [x.counts() for x in _slices(data, offsets)]
    key = np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)])
    count = np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)])
    different, place = np.unique(key, return_inverse=True)
    return different, np.bincount(place, count, len(different)).astype(np.int64)


class Runs:
    """The runs of a chunk: ``start``, ``count`` of strings that begin in it, ``key``, and hashes of its ``first`` and ``last`` string."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        found = [x.runs() for x in _slices(data, offsets)]
        empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 3
        self.start, self.count, self.key, self.first, self.last = map(np.concatenate, zip(*found)) if found else empty


def strings_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the string at each place, a slice of the data at a time."""
    out = np.zeros(len(at), np.uint64)
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    for begin in range(0, len(data), SLICE):
        a, b = np.searchsorted(ranked, (begin, begin + SLICE))
        if a < b:
            out[order[a:b]] = _strings(_rolling(data[begin : begin + SLICE + LEAST - 1]), ranked[a:b] - begin)
    return out


def _sliding(choice: np.ufunc, x: np.ndarray) -> np.ndarray:
    """The least or largest of every ``WINDOW`` values in a row."""
    size = 1
    while size * 2 <= WINDOW:
        x = choice(x[: len(x) - size], x[size:])
        size *= 2
    more = WINDOW - size
    return choice(x[: len(x) - more], x[more:])


def _rolling(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all pieces of 4, 32 and 64 bytes."""
    h, size, out = _BYTE[data], 1, {}
    while size < 64:
        h = h[: max(len(h) - size, 0)] * _power(size) + h[size:]
        size *= 2
        out[size] = h
    return {size: out[size] for size in (4, GRAM, 64)}


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), n, 1 << 64))


def _strings(by_size: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Hashes of strings of ``LEAST`` bytes, from a piece of 64, one of 32 and one of 4."""
    return mixed(by_size[64][at] * _power(36) + by_size[GRAM][at + 64] * _power(4) + by_size[4][at + 96])


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The indices of the keys of each bucket."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_KEYS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _send_keys(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release_memory()
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                key, count = key_counts(*utf8(_rows(body.as_buffer()).column("text")))
                count = np.minimum(count, 65535).astype(np.uint16)
                out = {"bucket": [], "chunk": [], "keys": [], "counts": []}
                for bucket, own in _by_bucket(key, buckets):
                    out["bucket"].append(bucket)
                    out["chunk"].append(chunk)
                    out["keys"].append(key[own].tobytes())
                    out["counts"].append(count[own].tobytes())
                yield _batch(out, _KEYS)

    return run


def _reply(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in rows["keys"]]
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["counts"]])
        total = np.bincount(place, count, len(different))
        state = ((total > 1).astype(np.uint8) + (total > hot))[place]
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        rows = rows[["chunk", "bucket"]].assign(states=[x.tobytes() for x in np.split(state, cuts)])
        return rows[[any(x) for x in rows["states"]]]

    return run


_PARTS = pa.schema(
    [
        ("bucket", pa.int64()),
        ("chunk", pa.int64()),
        ("spans", pa.bool_()),  # spans of the chunk itself, on their way to its end
        ("starts", pa.binary()),
        ("counts", pa.binary()),
        ("shares", pa.binary()),  # which share of the bucket each run belongs to
        ("digests", pa.binary()),
        ("places", pa.binary()),
        ("body", pa.binary()),
    ]
)


def _send_runs(key_buckets: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release_memory()
            for chunk, body, replies in zip(
                batch.column("chunk").to_pylist(), batch.column("rows"), batch.column("replies").to_pylist()
            ):
                rows = _rows(body.as_buffer())
                data, offsets = utf8(rows.column("text"))
                yield _batch(_repeated(rows, Runs(data, offsets), chunk, replies or [], key_buckets, buckets), _PARTS)

    return run


def _repeated(rows, runs: Runs, chunk: int, replies: list, key_buckets: int, buckets: int) -> dict:
    """What a chunk sends of the runs whose keys are repeated: each different run once; the rest are spans."""
    out = {f.name: [] for f in _PARTS}
    different, place = np.unique(runs.key, return_inverse=True)
    state = np.zeros(len(different), np.uint8)
    answers = {r["bucket"]: r["states"] for r in replies}
    for bucket, own in _by_bucket(different, key_buckets):
        if bucket in answers:
            state[own] = np.frombuffer(answers[bucket], np.uint8)
    state = state[place]
    some, hot = state == 1, np.flatnonzero(state == 2)
    n = runs.count[hot]
    single = np.repeat(runs.start[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = np.concatenate((runs.start[some], single))
    if not len(start):
        return out
    count = np.concatenate((runs.count[some], np.ones(len(single), np.int64)))
    alone = strings_at(runs.data, single)
    first, last = np.concatenate((runs.first[some], alone)), np.concatenate((runs.last[some], alone))
    key = np.concatenate((runs.key[some], alone))
    digest = mixed(last + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    text = np.searchsorted(runs.offsets, start, side="right") - 1
    doc = np.asarray(rows.column("doc_id").cast(pa.int64()).fill_null(_NONE))[text]
    within = start - runs.offsets[text]
    order = np.lexsort((within, text, doc, digest, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    again, kept = order[~new], order[new]

    def put(bucket: int, own: np.ndarray, spans: bool) -> None:
        out["bucket"].append(bucket)
        out["chunk"].append(chunk)
        out["spans"].append(spans)
        out["starts"].append(start[own].tobytes())
        out["counts"].append((count[own] + (LEAST - 1 if spans else 0)).astype(np.int64).tobytes())
        if spans:
            for name in ("shares", "digests", "places", "body"):
                out[name].append(None)
            return
        size = count[own] + LEAST - 1
        at = np.arange(int(size.sum())) + np.repeat(start[own] - np.cumsum(size) + size, size)
        out["shares"].append((key[own] // np.uint64(buckets) % np.uint64(SHARES)).astype(np.uint8).tobytes())
        out["digests"].append(np.concatenate((first[own], digest[own])).tobytes())
        out["places"].append(np.concatenate((doc[own], text[own], within[own])).astype(np.int64).tobytes())
        out["body"].append(pa.compress(runs.data[at].tobytes(), codec="zstd", asbytes=True))

    if len(again):
        put(int(mixed(np.array([chunk], np.uint64))[0] % np.uint64(buckets)), again, True)
    for bucket, own in _by_bucket(key[kept], buckets):
        put(bucket, kept[own], False)
    return out


_SPANS = "chunk long, starts binary, sizes binary"


class Received:
    """The runs that chunks sent to a bucket, as they came. Equal strings are in one share, and shares are worked on in turn."""

    def __init__(self, rows: pd.DataFrame):
        self.counts = np.concatenate([np.frombuffer(x, np.int64) for x in rows["counts"]])
        self.starts = np.concatenate([np.frombuffer(x, np.int64) for x in rows["starts"]])
        self.shares = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["shares"]])
        each = [len(x) // 8 for x in rows["counts"]]
        self.chunk = np.repeat(rows["chunk"].to_numpy(), each)
        self.digests = np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in rows["digests"]], axis=1)
        self.places = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in rows["places"]], axis=1)
        self.sizes = self.counts + LEAST - 1
        self.data = np.concatenate(
            [
                np.frombuffer(pa.decompress(x, int(own.sum()), codec="zstd", asbytes=True), np.uint8)
                for x, own in zip(rows["body"], np.split(self.sizes, np.cumsum(each)[:-1]))
            ]
        )


class Bucket:
    """The different runs of a share of a bucket, and which of their suffixes are repeats."""

    def __init__(self, received: Received, share: int):
        own = received.shares == share
        self.counts, self.starts, self.chunk = received.counts[own], received.starts[own], received.chunk[own]
        (first, digest), place, sizes = received.digests[:, own], received.places[:, own], received.sizes[own]
        self.data = received.data[np.repeat(own, received.sizes)]
        self.at = np.cumsum(sizes) - sizes
        # the earliest of equal runs stands for them, the others are repeats as a whole
        order = np.lexsort((place[2], place[1], self.chunk, place[0], digest, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        self.again, kept = order[~new], order[new]
        age = np.empty(len(order), np.int64)
        age[np.lexsort((place[2], place[1], self.chunk, place[0]))] = np.arange(len(order)) * WINDOW
        n = self.counts[kept]
        self.run = np.repeat(kept, n)
        self.offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.age = age[self.run] + self.offset

    def repeats(self) -> Iterator[tuple[int, np.ndarray, list[int], int]]:
        """(length, all occurrences, later ones, earliest) of every maximal repeat, by index of suffix."""
        begin = self.at[self.run] + self.offset
        if not len(begin):
            return
        # strings that no other suffix begins with are no part of an interval
        _, where, often = np.unique(strings_at(self.data, begin), return_inverse=True, return_counts=True)
        self.some = np.flatnonzero(often[where] > 1)
        if not len(self.some):
            return
        # equal strings meet in one part, and a part has a bounded number of suffixes
        group = where[self.some]
        order = np.argsort(group, kind="stable")
        for part in np.array_split(order, np.flatnonzero(_part_ends(group[order])) + 1):
            own = self.some[part]
            starts = begin[own]
            ends = self.at[self.run[own]] + self.counts[self.run[own]] + LEAST - 1
            left = np.where(self.offset[own] > 0, self.data[np.maximum(starts - 1, 0)].astype(np.int64), -1)
            array = EnhancedSuffixArray(self.data, starts, ends)
            for length, a, b, later, earliest in array.maximal_repeats(LEAST, left, self.age[own]):
                yield length, own[array.order[a : b + 1]], own[later], int(own[earliest])


def _part_ends(group: np.ndarray, limit: int = 200_000) -> np.ndarray:
    """After which of the sorted items a part ends, each of about ``limit`` items and of whole groups."""
    last = np.append(group[1:] != group[:-1], False)
    ends = np.zeros(len(group), bool)
    want = np.arange(limit, len(group), limit)
    stops = np.flatnonzero(last)
    at = np.searchsorted(stops, want)
    ends[stops[at[at < len(stops)]]] = True
    return ends


def _find(rows: pd.DataFrame) -> pd.DataFrame:
    own = rows[rows["spans"]]
    chunk = [np.repeat(c, len(x) // 8) for c, x in zip(own["chunk"], own["starts"])]
    start = [np.frombuffer(x, np.int64) for x in own["starts"]]
    size = [np.frombuffer(x, np.int64) for x in own["counts"]]
    rows = rows[~rows["spans"]]
    release_memory()
    received = Received(rows) if len(rows) else None
    for share in np.unique(received.shares).tolist() if received else ():
        bucket = Bucket(received, share)
        chunk.append(bucket.chunk[bucket.again])
        start.append(bucket.starts[bucket.again])
        size.append(bucket.counts[bucket.again] + LEAST - 1)
        later, lengths = [], []
        for length, _, others, _ in bucket.repeats():
            later.append(others)
            lengths.append(np.full(len(others), length))
        if later:
            suffix = np.concatenate(later).astype(np.int64)
            run = bucket.run[suffix]
            chunk.append(bucket.chunk[run])
            start.append(bucket.starts[run] + bucket.offset[suffix])
            size.append(np.concatenate(lengths))
    chunk, start, size = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (chunk, start, size))
    order = np.lexsort((start, chunk))
    chunk, start, size = chunk[order], start[order], size[order]
    # overlapping spans of a chunk become one
    end = start + size
    base = np.cumsum(np.diff(chunk, prepend=chunk[:1]) != 0) * np.int64(1 << 40)
    reach = np.maximum.accumulate(end + base) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = (start + base)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(start)) - 1
    merged = chunk[first], start[first], (reach[stop] - base[stop] - start[first]) if len(first) else start
    cuts = np.flatnonzero(np.diff(merged[0])) + 1
    parts = [np.split(x, cuts) for x in merged] if len(first) else [[], [], []]
    return pd.DataFrame(
        {"chunk": [int(c[0]) for c in parts[0]], "starts": [x.tobytes() for x in parts[1]], "sizes": [x.tobytes() for x in parts[2]]}
    )


def _removed(rows: pa.RecordBatch, spans: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the chunk, the bounds of its texts, and which bytes go."""
    data, offsets = utf8(rows.column("text"))
    turn = np.zeros(len(data) + 1, np.int32)
    for span in spans or []:
        start, size = np.frombuffer(span["starts"], np.int64), np.frombuffer(span["sizes"], np.int64)
        np.add.at(turn, start, 1)
        np.add.at(turn, start + size, -1)
    return data, offsets, np.cumsum(turn[:-1], dtype=np.int32) > 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        release_memory()
        for body, spans in zip(batch.column("rows"), batch.column("all_spans").to_pylist()):
            rows = _rows(body.as_buffer())
            data, offsets, gone = _removed(rows, spans)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            inside = offsets[offsets < len(data)]
            first[inside] = gone[inside]
            total, runs = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (gone, first))
            sha = [
                hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(np.diff(total), pa.int64()),
                    pa.array(np.diff(runs), pa.int64()),
                    pa.array(sha),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        release_memory()
        for body, spans in zip(batch.column("rows"), batch.column("all_spans").to_pylist()):
            rows = _rows(body.as_buffer())
            data, offsets, gone = _removed(rows, spans)
            total = np.concatenate(([0], np.cumsum(gone)))[offsets]
            changed = np.diff(total) > 0
            texts, chars = rows.column("text").to_pylist(), rows.column("n_chars").to_pylist()
            for t in np.flatnonzero(changed).tolist():
                a, b = int(offsets[t]), int(offsets[t + 1])
                texts[t] = data[a:b][~gone[a:b]].tobytes().decode(errors="ignore")
                chars[t] = len(texts[t])
            kept = pa.array(~changed | (np.diff(total) < np.diff(offsets)))
            new = {"text": pa.array(texts, rows.schema.field("text").type), "n_chars": pa.array(chars, pa.int64())}
            columns = [new.get(f.name, rows.column(f.name)) for f in rows.schema]
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names).filter(kept)


class Repeats:
    """Chunks of a table of documents with the spans that repeat earlier ones."""

    def __init__(self, docs: DataFrame, hot: int = HOT, key_bytes: int = KEY_BYTES, run_bytes: int = RUN_BYTES):
        spark = prepared(docs.sparkSession, 2048)
        workspace = Workspace(spark)
        chunks = docs.mapInArrow(_to_chunks, "chunk long, size long, rows binary")
        self.chunks = workspace.stage(chunks, "chunks")
        # a row is a megabyte or two long: a few at a time
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
        total = self.chunks.agg(F.sum("size")).first()[0] or 0
        keys, self.buckets = 1 + total // key_bytes, 1 + total // run_bytes
        sent = self.chunks.mapInArrow(_send_keys(keys), "bucket long, chunk long, keys binary, counts binary")
        replies = sent.groupBy("bucket").applyInPandas(_reply(hot), "chunk long, bucket long, states binary")
        replies = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "states")).alias("replies"))
        asked = self.chunks.join(replies, "chunk")
        self.runs = asked.mapInArrow(
            _send_runs(keys, self.buckets),
            "bucket long, chunk long, spans boolean, starts binary, counts binary, shares binary,"
            " digests binary, places binary, body binary",
        )
        spans = workspace.stage(self.runs.groupBy("bucket").applyInPandas(_find, _SPANS), "spans")
        self.spans = spans.groupBy("chunk").agg(F.collect_list(F.struct("starts", "sizes")).alias("all_spans"))

    def marked(self) -> DataFrame:
        return self.chunks.join(self.spans, "chunk", "left").select("rows", "all_spans")


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return Repeats(docs).marked().mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose what repeats an earlier passage (a cut character goes too); a document
    of which nothing is left goes."""
    return Repeats(docs).marked().mapInArrow(_cut, docs.schema)
