"""WARC archives: records written into one gzip stream, and a normaliser that makes them seekable.

A monolithic archive is one gzip member over all its records, so no record can be read without all
before it. The normaliser inflates such a stream once, from begin to end and piece by piece, writes
every record as a gzip member of its own and beside the new archive an index: a line of JSON for each
record with offset and length of its member, type and page. Streams of many members are accepted, too.

Equal payloads of ``least`` bytes or more are written once, as response of the smallest page_id; the
other pages are revisit records, which have the headers but no payload. A null html is an empty
payload. A row without a page_id revisits the response of its payload if there is one; rows that
repeat the smallest page_id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paidup.llm.files import created, new_folder, opened
from paidup.llm.session import prepared
from paidup.workspace import Workspace

#: Bytes of records in an archive, after which a task begins another one.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; the page ids and the length of the payload are extension fields."""
    block = _HTTP if revisit else _HTTP + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{revisit}")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else _field(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("WARC-X-Page-ID", page_id),
        ("WARC-X-Payload-Length", len(payload)),
        ("WARC-X-Refers-To-Page", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def inflated(file) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or several, piece by piece."""
    member, waiting = zlib.decompressobj(31), b""
    began = False
    while True:
        data = waiting or file.read(READ_BYTES)
        waiting = b""
        if not data:
            if began:
                raise ValueError("the gzip stream is cut off")
            return
        began = True
        yield member.decompress(data)
        if member.eof:
            waiting, member, began = member.unused_data, zlib.decompressobj(31), False


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream; no more than one record and one piece are held."""
    buffer = bytearray()
    end = None
    for piece in pieces:
        buffer += piece
        while True:
            if end is None:
                head = buffer.find(b"\r\n\r\n")
                if head < 0:
                    break
                fields = bytes(buffer[:head]).decode().split("\r\n")
                size = next(int(f.split(":", 1)[1]) for f in fields if f.lower().startswith("content-length:"))
                end = head + 4 + size + 4
            if len(buffer) < end:
                break
            yield bytes(buffer[:end])
            del buffer[:end]
            end = None
    if buffer:
        raise ValueError("the last record is cut off")


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, counts, out = [], [], None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit"))
            for page_id, url, html, refers_to, revisit in zip(*columns):
                if out is None:
                    out, path = created(folder, ".warc.gz")
                    pack, size = zlib.compressobj(3, zlib.DEFLATED, 31), 0
                    paths.append(path)
                    counts.append(0)
                data = record(page_id, url, (html or "").encode(), refers_to, revisit)
                out.write(pack.compress(data))
                counts[-1] += 1
                size += len(data)
                if size >= limit:
                    out.write(pack.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "n_records"])

    return run


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out, new = created(folder, ".warc.gz")
                index, lines = created(folder, ".idx")
                at = n = 0
                with opened(path) as file, out, index:
                    for data in records(inflated(file)):
                        fields, _ = parsed(data)
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(data) + pack.flush()
                        entry = {"offset": at, "length": len(member), "type": fields.get("WARC-Type"), "page_id": fields.get("WARC-X-Page-ID")}
                        out.write(member)
                        index.write(json.dumps(entry).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new]), pa.array([lines]), pa.array([n], pa.int64())], ["path", "index", "n_records"]
                )

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
            with opened(index) as file:
                entries = [json.loads(line) for line in file.read().splitlines()]
            rows = []
            with opened(path) as file:
                for entry in entries:
                    member = file.read_at(entry["length"], entry["offset"])
                    fields, block = parsed(zlib.decompress(member, 31))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(fields["WARC-X-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: the payload at {entry['offset']} does not fit its digest")
                    rows.append(
                        (number(fields.get("WARC-X-Page-ID")), size, digest, kind, number(fields.get("WARC-X-Refers-To-Page")))
                    )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


def _dealt(files: DataFrame) -> DataFrame:
    """A task for every few files; a number that is asked for is not coalesced."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes monolithic archives, a row (path, n_records) for each."""
    spark = prepared(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = own.withColumn("digest", F.sha1(payload)).withColumn("size", F.octet_length(payload))
    firsts = own.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    both = own.join(firsts, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = both.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return Workspace(spark).stage(
        typed.mapInArrow(_write(new_folder(spark, "warc"), archive_bytes), "path string, n_records long"), "archives"
    )


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrites archives with a member for each record and an index, a row (path, index, n_records) for each."""
    spark = prepared(archives.sparkSession)
    found = _dealt(archives.select("path")).mapInArrow(
        _normalise(new_folder(spark, "warc-members")), "path string, index string, n_records long"
    )
    return Workspace(spark).stage(found, "members")


def read_records(members: DataFrame) -> DataFrame:
    """The records of normalised archives, each read by its index entry alone."""
    return _dealt(members.select("path", "index")).mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return read_records(normalise(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
