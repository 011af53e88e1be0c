"""WARC archives: a writer that stores equal payloads once, and a reader that survives damage.

Archives are written by Spark's text writer, so its commit protocol covers lost executors and any file system serves: a row is one
gzip member with one record, and the line separator is an empty gzip member, which readers skip.  The reader takes whole
archives, compressed by record or plain.  Where a check fails (version line, headers, length, gzip CRC, block digest) it looks for
the next member or version line that holds a valid record, goes on there and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stored

RECORDS_PER_FILE = 2_000
GZIP_LEVEL = 2
#: Payloads that repeat are broadcast up to this number and joined by shuffle beyond.
BROADCAST_PAYLOADS = 200_000
#: A member is inflated from pieces of so many bytes: what follows its end in a piece is copied.
PIECE_BYTES = 8_192
GZIP_MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", 9, mtime=0)
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
FIXED_DATE = "2024-01-01T00:00:00Z"
READ_SCHEMA = ("kind string, path string, start long, end long, reason string, record_id string, record_type string, uri string, "
               "refers_to string, payload_digest string, payload_bytes long, payload binary")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value holds no line breaks."""
    return re.sub(r"[\r\n]+", " ", value)


def record(record_id: str, uri: str, payload: bytes, payload_digest: str, refers_to: str | None, payload_bytes: int | None = None) -> bytes:
    """One response or, with ``refers_to``, revisit record; a revisit holds no payload but its digest and length.

    With ``payload_bytes`` given, the payload of a revisit need not be.
    """
    size = len(payload) if payload_bytes is None else payload_bytes
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{record_id}>"),
            ("WARC-Date", FIXED_DATE), ("WARC-Target-URI", _line(uri)),
            *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
              if revisit else []),
            ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Payload-Length", str(size)),
            ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def hashed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_sha1); NULL html and urls are empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return rows.withColumn("payload_sha1", F.sha1("payload"))


def repeated(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(payload_sha1, largest): the payloads of at least ``least_bytes`` bytes that occur more than once, with their largest ``page_id``.

    A payload without any ``page_id`` is left out.  The ids of a payload are reduced to one before they are shuffled.
    """
    return (rows.where(F.octet_length("payload") >= least_bytes).groupBy("payload_sha1")
            .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("_n"))
            .where((F.col("_n") > 1) & F.col("largest").isNotNull()).drop("_n"))


def resolved(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_sha1, refers_to): which rows repeat the payload of another.

    Of the pages of a group of ``repeated`` payloads, the largest ``page_id`` stands for itself and the others refer to it, without
    their payload; all other pages stand for themselves.  A NULL ``page_id`` is below every other; repeated rows of the largest
    id all stand for themselves.  Rows stay where they are read as long as the groups can be broadcast.
    """
    if groups.count() <= BROADCAST_PAYLOADS:
        groups = F.broadcast(groups)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return (rows.join(groups, "payload_sha1", "left").withColumn("refers_to", refers)
            .select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                    F.octet_length("payload").alias("payload_bytes"), "payload_sha1", "refers_to"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives of (``page_id``, ``url``, ``html``) below ``path``; an empty table writes no record; further columns are ignored.

    Of equal payloads of at least ``least_bytes`` bytes that of the largest id is stored; smaller ones always stand for themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, payload, size, sha1, refers in zip(*(batch.column(i) for i in range(6))):
                ref = refers.as_py()
                name = "" if page.as_py() is None else str(page.as_py())
                raw = record(name, url.as_py(), payload.as_py() or b"", base64.b32encode(bytes.fromhex(sha1.as_py())).decode(),
                             None if ref is None else str(ref), size.as_py())
                out.append(gzip.compress(raw, GZIP_LEVEL, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    rows = hashed(pages)
    groups = stored(repeated(rows, least_bytes), "repeated-payloads")
    members = resolved(rows, groups).mapInArrow(run, "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write.mode("errorifexists")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", records_per_file).text(path))
    discard(groups)


class Damaged(Exception):
    """A check failed; the message says which."""


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None, bool]:
    """What the member at ``at`` holds, its end, and None; or what was inflated before it failed, ``at``, the reason, and whether
    these bytes are as they were written (the member is only cut off).
    """
    unzip, out = zlib.decompressobj(31), []
    try:
        for start in range(at, len(data), PIECE_BYTES):
            piece = data[start:start + PIECE_BYTES]
            out.append(unzip.decompress(piece))
            if unzip.eof:
                return b"".join(out), start + len(piece) - len(unzip.unused_data), None, True
    except zlib.error as error:
        return _before_failure(data, at), at, f"gzip member: {error}", False
    return b"".join(out) + unzip.flush(), at, "gzip member is cut off", True


def _before_failure(data: bytes, at: int, step: int = 4096) -> bytes:
    """The bytes inflated before the first error: by pieces, and the piece with the error byte by byte."""
    unzip, out = zlib.decompressobj(31), []
    while at < len(data):
        kept = unzip.copy()
        try:
            out.append(unzip.decompress(data[at:at + step]))
        except zlib.error:
            if step == 1:
                break
            unzip, step = kept, 1
        else:
            at += step
    return b"".join(out)


def _parts(raw: bytes, verify: bool, sure: bool = True) -> Iterator[dict]:
    """Records and gaps of an inflated member; unless the bytes are ``sure``, a verified record has a block digest."""

    def checked(at: int) -> tuple[dict, int]:
        got, end = _record(raw, at, verify)
        if verify and not sure and not got["head"].get("warc-block-digest"):
            raise Damaged("no block digest in a damaged member")
        return got, end

    at = 0
    while at < len(raw):
        try:
            got, end = checked(at)
        except Damaged as why:
            end = len(raw)
            for found in VERSION.finditer(raw, at + 1):
                try:
                    checked(found.start())
                except Damaged:
                    continue
                end = found.start()
                break
            yield {"kind": "gap", "reason": str(why), "inner": (at, end)}
        else:
            yield {"kind": "record", **got}
        at = end


def _record(data: bytes, at: int, verify: bool) -> tuple[dict, int]:
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Damaged("headers do not end")
    head: dict[str, str] = {}
    for line in data[version.end():head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header without colon")
        head[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[start:end]
    want = head.get("warc-block-digest")
    if verify and want and want != f"sha1:{digest(block)}":
        raise Damaged("block digest")
    http_end = block.find(b"\r\n\r\n")
    payload = block[http_end + 4:] if head.get("content-type", "").startswith("application/http") and http_end >= 0 else block
    want = head.get("warc-payload-digest", "")
    if verify and head.get("warc-type") != "revisit" and want.startswith("sha1:") and want != f"sha1:{digest(payload)}":
        raise Damaged("payload digest")
    return {"head": head, "payload": payload}, end + 4


def salvage(data: bytes, verify: bool = True) -> Iterator[dict]:
    """Records and gaps of one archive in order of their bytes; ``start`` and ``end`` are places in ``data``.

    Every byte lies in a record's member or text, in an empty member or in a gap.  Records and gaps inside one member have its start and
    end, and the reason of such a gap says which inflated bytes it holds; of a damaged member the bytes before the failure are
    salvaged.  An empty archive gives nothing.
    """
    at = 0
    while at < len(data):
        if data.startswith(GZIP_MAGIC, at):
            raw, end, failed, sure = _member(data, at)
            parts = list(_parts(raw, verify, sure))
            if failed:
                end = _next_valid(data, at + 1, verify, raw)
            if not any(p["kind"] == "record" for p in parts):
                parts = [{"kind": "gap", "reason": failed or parts[0]["reason"]}] if failed or parts else []
            elif failed:
                parts.append({"kind": "gap", "reason": failed, "inner": (len(raw), len(raw))})
        else:
            try:
                got, end = _record(data, at, verify)
                parts = [{"kind": "record", **got}]
            except Damaged as why:
                end = _next_valid(data, at + 1, verify)
                parts = [{"kind": "gap", "reason": str(why)}]
        for part in parts:
            inner = part.pop("inner", None)
            if inner:
                part["reason"] += f" (from byte {inner[0]} to {inner[1]} of the inflated member)"
            yield {"start": at, "end": end, **part}
        at = end


def _next_valid(data: bytes, at: int, verify: bool, known: bytes = b"") -> int:
    """The next place where a record can be read, or the end; plain records that ``known`` holds (stored, not compressed) do not count."""
    places = re.compile(re.escape(GZIP_MAGIC) + rb"|WARC/1\.[01]\r\n")
    for found in places.finditer(data, at):
        if data.startswith(GZIP_MAGIC, found.start()):
            raw, _, failed, sure = _member(data, found.start())
            if not (raw or failed) or any(p["kind"] == "record" for p in _parts(raw, verify, sure)):
                return found.start()
            continue
        try:
            _, end = _record(data, found.start(), verify)
        except Damaged:
            continue
        if not known or data[found.start():end] not in known:
            return found.start()
    return len(data)


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:page:"):-1] if urn and urn.startswith("<urn:page:") else urn


def read(spark: SparkSession, path: str, verify: bool = True, payloads: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archives below ``path``; a task holds one archive at a time.

    Without ``payloads`` that column stays in the tasks, which read and verify it all the same.
    """
    fields = READ_SCHEMA.split(", ") if payloads else READ_SCHEMA.split(", ")[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for got in salvage(content.as_py(), verify):
                    head = got.get("head", {})
                    payload = got.get("payload")
                    size = head.get("x-payload-length")
                    rows.append((got["kind"], where.as_py(), got["start"], got["end"], got.get("reason"), _page(head.get("warc-record-id")),
                                 head.get("warc-type"), head.get("warc-target-uri"), _page(head.get("warc-refers-to")),
                                 head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                                 int(size) if size and size.isdigit() else None if payload is None else len(payload), *[payload] * payloads))
                    held += len(payload or b"") * payloads
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ", ".join(fields))
