"""WARC archives: monolithic gzip files, their normaliser, and a reader by sidecar index.

write() packs pages into archives that are one gzip stream each. normalise() inflates each such stream once,
in bounded pieces, rewrites every record as a gzip member of its own and writes a sidecar (one JSON line a
record: offset, length, type, id) beside it. read() takes the members by the sidecars' offsets.

Of records with equal payloads of `least` bytes or more, that with the smallest page id is the response and
the others are revisits that refer to it and carry no payload.

Cases: a null html is the empty payload; a null id sorts after all others, and its record is a revisit if
any page with an id has its payload, else a response; rows that repeat the smallest id as well as the payload
are all responses; a null url becomes urn:page:<id>; line breaks in urls are escaped; no rows give no archive.
A stream that ends early or a broken record raises ValueError. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import files
from quern.llm.common import new_path, salted_join, settle
from quern.ship import ship

CRLF = b"\r\n"
PIECE = 1 << 20


@dataclass(frozen=True)
class WarcParams:
    least: int = 100  # bytes of a payload that may be revisited
    archive_bytes: int = 256 << 20  # of records, before a task begins its next archive
    first_level: int = 1  # of the monolithic stream, which is read once
    level: int = 4


def plan(pages: DataFrame, p: WarcParams = WarcParams(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = rows.where(F.octet_length("payload") >= p.least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    found = salted_join(rows, settle(same.select("digest", "first"), "same"), ["digest"], F.struct("page_id", "url"))
    return found.select("page_id", "url", F.when(F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")), F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("bytes"), "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    name = "" if page_id is None else str(page_id)
    uri = (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + CRLF + CRLF


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, mark, rest = rec.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflate(source) -> Iterator[bytes]:
    """The plain bytes of a file of one gzip stream or of several members, a piece at a time."""
    z = None
    while piece := source.read(PIECE >> 4):
        while piece:
            z = z or zlib.decompressobj(31)
            if out := z.decompress(piece):
                yield out
            piece, z = (z.unused_data, None) if z.eof else (b"", z)
    if z is not None:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, each with its two closing line ends, from a stream cut anywhere."""
    buf, at = bytearray(), 0
    need = None
    for piece in pieces:
        buf += piece
        while True:
            if need is None:
                end = buf.find(CRLF + CRLF, at)
                if end < 0:
                    break
                fields = buf[at:end].split(CRLF)
                if not fields[0].startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                size = next((int(f.partition(b":")[2]) for f in fields if f.lower().startswith(b"content-length:")), None)
                if size is None:
                    raise ValueError("a record without Content-Length")
                need = end + 4 + size + 4
            if len(buf) < need:
                break
            yield bytes(buf[at:need])
            at, need = need, None
        if at > PIECE:
            del buf[:at]
            need = need and need - at
            at = 0
    if len(buf) > at:
        raise ValueError("the last record is cut")


def _writer(root: str, p: WarcParams):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with files.replacing(path) as f:
                z = zlib.compressobj(p.first_level, zlib.DEFLATED, 31)
                while row is not None and size < p.archive_bytes:
                    rec = record(*row)
                    f.write(z.compress(rec))
                    n, size, row = n + 1, size + len(rec), next(rows, None)
                f.write(z.flush())
            yield pa.record_batch([[path], [n], [size]], schema=schema)

    return run


def write(planned: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """Archives of one gzip stream each: (path, records, bytes), a row for each archive."""
    ship(planned.sparkSession)
    root = new_path(planned.sparkSession, "warc")
    rows = planned.select("page_id", "url", "payload", "bytes", "digest", "refers_to")
    return settle(rows.mapInArrow(_writer(root, p), "path string, records long, bytes long"), "archives")


def rewrite(path: str, to: str, level: int) -> tuple[int, int]:
    """Normalise one archive into `to` and its sidecar `to`.idx; (records, bytes written)."""
    n = offset = 0
    with files.reading(path) as source, files.replacing(to) as out, files.replacing(f"{to}.idx") as index:
        for rec in records(inflate(source)):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(rec) + z.flush()
            out.write(member)
            head = rec[: rec.find(CRLF + CRLF)].split(CRLF)
            of = lambda name: next((x.partition(b":")[2].strip().decode("utf-8", "replace") for x in head if x.lower().startswith(name)), None)
            index.write(json.dumps({"offset": offset, "length": len(member), "type": of(b"warc-type:"), "id": of(b"warc-record-id:")}).encode() + b"\n")
            offset += len(member)
            n += 1
    return n, offset


def _spread(archives: DataFrame) -> DataFrame:
    """One task for each archive."""
    return archives.repartition(max(1, archives.count()))


def normalise(archives: DataFrame, p: WarcParams = WarcParams(), discard: bool = False) -> DataFrame:
    """Rewrite every archive at `path` with a member for each record: (path, records, bytes) of the new ones."""
    ship(archives.sparkSession)
    root = new_path(archives.sparkSession, "warc")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for b in batches:
            for path in b["path"].to_pylist():
                to = f"{root}/{uuid.uuid4().hex}.warc.gz"
                n, size = rewrite(path, to, p.level)
                yield pa.record_batch([[to], [n], [size]], schema=schema)

    done = settle(_spread(archives.select("path")).mapInArrow(run, "path string, records long, bytes long"), "members")
    if discard:
        _spread(archives.select("path")).foreachPartition(lambda rows: [files.remove(r["path"]) for r in rows])
    return done


def read(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, a member at a time by its sidecar's offset."""
    ship(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def page(uri: str | None) -> int | None:
        return int(x) if uri and (x := uri.strip("<>").rpartition(":")[2]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                out, held = [], 0
                with files.reading(path) as f, files.reading(f"{path}.idx") as index:
                    lines = (json.loads(x) for x in _lines(index))
                    for line in lines:
                        f.seek(line["offset"])
                        rec = zlib.decompress(f.read(line["length"]), 31)
                        fields, block = parse(rec)
                        if fields["warc-record-id"] != line["id"]:
                            raise ValueError(f"{path}: the sidecar's offset {line['offset']} is another record's")
                        head, _, payload = block.partition(CRLF + CRLF)
                        size = next(int(x.partition(b":")[2]) for x in head.split(CRLF) if x.lower().startswith(b"content-length:"))
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        kind = fields["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: payload and digest differ at {line['offset']}")
                        out.append((page(fields["warc-record-id"]), size, digest, kind, page(fields.get("warc-refers-to")), fields["warc-target-uri"], payload if kind == "response" else None))
                        held += len(rec)
                        if held > 16 * PIECE:
                            yield _batch(out, schema)
                            out, held = [], 0
                if out:
                    yield _batch(out, schema)

    return _spread(archives.select("path")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _lines(index) -> Iterator[bytes]:
    rest = b""
    while piece := index.read(PIECE):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole


def archive(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """pages to normalised archives (path, records, bytes); the monolithic files are removed."""
    return normalise(write(plan(pages, p), p), p, discard=True)
