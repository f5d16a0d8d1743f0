"""WARC archives: one gzip member per record, written and read by parallel tasks.

Writing. Each page is first compressed into its response record; only then do pages move, to meet
the smallest page of the same payload digest, so a shuffle carries compressed records. A page that
is not the smallest becomes a revisit record without payload. Spark's text writer puts the files in
place, with its commit protocol: a member's header ends with a file name and a zero byte, and that zero is
the writer's line separator. The one after the last member is zero padding, which gzip allows.

Reading is splittable. The archives are cut into byte ranges without regard to records. The task of
a range looks for the gzip magic, takes a place for a member only if its first bytes inflate to a WARC version
line, and owns the records that begin inside its range, reading past its end to finish the last one.
Any range size gives the same records.

Defined cases: a null html is an empty payload; a null page_id stands for no id: it is a revisit if another
page has its payload, and itself the response otherwise; rows that repeat a smallest page_id are all responses;
an empty table writes no records. Extra columns are not read. A damaged member is skipped up to the next
valid one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmap.sources.scratch import scratch_folder

MAGIC = b"\x1f\x8b\x08"
#: gzip header up to the zero that ends the file name.
HEAD = MAGIC + b"\x08\x00\x00\x00\x00\x00\xffrecord.warc"
SEPARATOR = "\0"
RANGE_BYTES = 8 << 20
_WINDOW = 1 << 18
_LEVEL = 3
_NAME = "urn:page:"


def _member(block: bytes) -> bytes:
    """A gzip member without its fixed header."""
    coder = zlib.compressobj(_LEVEL, zlib.DEFLATED, -15)
    body = coder.compress(block) + coder.flush()
    return body + zlib.crc32(block).to_bytes(4, "little") + (len(block) & 0xFFFFFFFF).to_bytes(4, "little")


def _record(kind: str, page_id, url: str | None, digest: str, http: bytes, first=None) -> bytes:
    name = lambda i: f"<{_NAME}{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {name(first)}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}", "", ""]
    return "\r\n".join(lines).encode() + http + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _compressed(pages: DataFrame) -> DataFrame:
    """page_id, digest, size, url and the response member of each page."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [])
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                block = _record(
                    "response", page_id.as_py(), url.as_py(), digest, _http(len(payload)) + payload
                )
                for col, value in zip(rows, (digest, len(payload), _member(block)), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(rows[0], pa.string()),
                    pa.array(rows[1], pa.int64()),
                    pa.array(rows[2], pa.binary()),
                ],
                ["page_id", "url", "digest", "size", "member"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        pack, "page_id long, url string, digest string, size long, member binary"
    )


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write (page_id, url, html) as WARC files under ``folder``."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # Minima are taken in each task first; as a written table they let the join split a hot digest.
    firsts = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("sha"))
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(_base32(F.col("sha")).alias("digest"), "first")
    )
    known = f"{folder}-firsts"
    firsts.write.parquet(known)
    firsts = pages.sparkSession.read.schema("digest string, first long").parquet(known)
    joined = _compressed(pages).join(firsts.hint("merge"), "digest", "left")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            lines = []
            for page_id, url, digest, size, member, first in zip(*batch.columns, strict=True):
                if first.is_valid and first.as_py() != page_id.as_py():
                    body = _member(
                        _record(
                            "revisit", page_id.as_py(), url.as_py(), digest.as_py(), _http(size.as_py()), first.as_py()
                        )
                    )
                else:
                    body = member.as_py()
                if last is None:
                    lines.append(HEAD)
                else:
                    lines.append(last + HEAD)
                last = body
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["value"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary())], ["value"])

    lines = joined.select("page_id", "url", "digest", "size", "member", "first").mapInArrow(emit, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).text(folder)


def _base32(hex_digest):
    """Base32 of a 40-digit hex string, in built-ins: 8 groups of 20 bits, 4 letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    number = [F.conv(F.substring(hex_digest, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(
        *[
            F.substring(F.lit(letters), (F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1), F.lit(1))
            for n in number
            for k in range(4)
        ]
    )


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by their names in lower case."""
    return {n.strip().lower(): v.strip() for n, found, v in (line.partition(":") for line in lines) if found}


def _page(name: str | None) -> int | None:
    """The page of a record id written here; none for ids of other writers."""
    text = (name or "").strip("<>")
    number = text.removeprefix(_NAME)
    return int(number) if text.startswith(_NAME) and number.lstrip("-").isdigit() else None


def _parse(block: bytes) -> dict | None:
    """A record. A payload that a given SHA-1 belies is no record; without one it is taken as it is. Other kinds than response
    and revisit have the size of their block and no payload."""
    head, found, rest = block.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = _fields(head.decode("utf-8", "replace").split("\r\n")[1:])
    size = fields.get("content-length", "0")
    body = rest[: int(size) if size.isdigit() else 0]
    kind = fields.get("warc-type", "").lower()
    given = fields.get("warc-payload-digest", "")
    row = {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": len(body),
        "payload_digest": given.removeprefix("sha1:") or None,
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": None,
    }
    if kind not in ("response", "revisit"):
        return row
    status, _, payload = body.partition(b"\r\n\r\n")
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if given.startswith("sha1:") and row["payload_digest"].upper() != digest:
            return None
        return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": row["payload_digest"] or digest}
    told = _fields(status.decode("latin-1").split("\r\n")[1:]).get("content-length", "")
    return row | {"payload_bytes": int(told) if told.isdigit() else len(payload)}


def owned_records(source, size: int, start: int, end: int) -> Iterator[dict]:
    """Records whose gzip member begins in [start, end) of an open file of ``size`` bytes."""
    at, window, base = start, b"", start

    def fill(upto: int) -> None:
        """Have bytes [base, upto) at hand, as far as the file goes."""
        nonlocal window
        upto = min(upto, size)
        if upto > base + len(window):
            source.seek(base + len(window))
            window += source.read(upto - base - len(window))

    while at < end:
        window, base = window[at - base :], at
        fill(at + _WINDOW)
        hit = window.find(MAGIC)
        if hit < 0:
            at = base + max(len(window) - 2, 1)
            if base + len(window) >= size:
                return
            continue
        at = base + hit
        if at >= end:
            return
        window, base = window[hit:], at
        fill(at + 4096)
        coder, text, used = zlib.decompressobj(31), b"", 0
        try:
            text = coder.decompress(window[:4096], 4096)
            if not (text.startswith(b"WARC/1.") or (coder.eof and not text)):
                raise zlib.error
            coder, parts, used = zlib.decompressobj(31), [], 0
            while not coder.eof:
                if used >= len(window):
                    fill(base + len(window) + _WINDOW)
                    if used >= len(window):
                        raise zlib.error
                piece = window[used:]
                parts.append(coder.decompress(piece))
                used = len(window)
            used -= len(coder.unused_data)
        except zlib.error:
            at += 1
            continue
        record = _parse(b"".join(parts))
        if record:
            yield record
        at += used


def read_archives(
    spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, payload: bool = True
) -> DataFrame:
    """All records of the archives under ``folder``: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, unless ``payload`` is off, the payload of responses."""
    ranges = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(folder)
        .select("path", "length")
        .where("length > 0")
        .select(
            "path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("start")
        )
    )
    n = max(1, ranges.count())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    fields = [*(f.split()[0] for f in schema.split(", ")), *(["payload"] if payload else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, name = fs.FileSystem.from_uri(_uri(path))
                with files.open_input_file(name) as source:
                    rows, held = [], 0
                    for record in owned_records(source, length, start, start + range_bytes):
                        rows.append(record)
                        held += len(record["payload"] or b"") if payload else 100
                        if held > 4 << 20:
                            yield _batch(rows, fields, kinds)
                            rows, held = [], 0
                    yield _batch(rows, fields, kinds)

    return ranges.repartition(min(n, 10_000), "path", "start").mapInArrow(
        scan, schema + (", payload binary" if payload else "")
    )


def _uri(path: str) -> str:
    """Spark's form of a path in the form pyarrow takes."""
    if path.startswith("file:/"):
        return "file:///" + path[5:].lstrip("/")
    return path.replace("s3a://", "s3://", 1)


def _batch(rows: list[dict], fields: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[f] for r in rows], k) for f, k in zip(fields, kinds, strict=False)], fields
    )


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
