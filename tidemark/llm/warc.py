"""Legacy archives: ARC files of either header version, and their conversion to WARC.

An ARC file begins with a version block whose second line names the version and whose third names the fields of the
record header lines; each record is such a line, then as many bytes as its last field declares, then a line end. The
converter splits records by those lengths, parses the line by the version's fields, and writes WARC records with the
same capture: the 14-digit date as ISO 8601, a record id made from the capture's key and place, the payload's SHA-1 in base 32,
and type response, or revisit where an earlier capture has the same payload.

Files are written by Spark's text writer, a record a row, so they are committed and retried as any output and reach
any file system Spark writes to; they are read back whole as binary files, so a file should stay well under an
executor's memory (FILE_BYTES). Records may hold any bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Aimed-at bytes of payload in a file before compression.
FILE_BYTES = 24 << 20
#: Payloads smaller than this are always responses.
LEAST_REVISIT = 0
DEFAULT_DATE, DEFAULT_IP = "19700101000000", "0.0.0.0"

# The fields of record header lines by version, as the archives' version blocks list them.
ARC_FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRLF = b"\r\n"
#: What a page without an id has in its place.
NO_PAGE = b"none"
_NO_PAGE = re.compile(rb"^X-Page-Id:[ \t]*none[ \t\r]*$", re.IGNORECASE | re.MULTILINE)
_PAGE = re.compile(rb"^X-Page-Id:[ \t]*(-?\d+)[ \t\r]*$", re.IGNORECASE | re.MULTILINE)
_GAP = re.compile(r"[\x00-\x20\x7f]+")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int, place: int = 0) -> str:
    """A version-8 UUID that holds a capture's 64-bit key, so that it leads back to it, and 58 bits of the record's place.

    Captures that share a key, as rows with one page_id do, so have different ids.
    """
    bits, other = key & 0xFFFFFFFFFFFFFFFF, place & 0x3FFFFFFFFFFFFFF
    whole = (0xA3C ^ other >> 46) << 116 | (bits >> 52) << 104 | ((other >> 22) & 0xFFFFFF) << 80 | 0x8 << 76 | ((bits >> 40) & 0xFFF) << 64 | 0x2 << 62 | (other & 0x3FFFFF) << 40 | (bits & 0xFFFFFFFFFF)
    return f"urn:uuid:{uuid.UUID(int=whole)}"


def record_place(file: str, number: int) -> int:
    """64 bits of a digest of the file's name and the record's number in it."""
    return int.from_bytes(hashlib.sha256(f"{file.rpartition('/')[2]} {number}".encode()).digest()[:8], "big", signed=True)


def record_key(name: str) -> int:
    n = uuid.UUID(name.removeprefix("<").removesuffix(">").removeprefix("urn:uuid:")).int
    bits = ((n >> 104) & 0xFFF) << 52 | ((n >> 64) & 0xFFF) << 40 | (n & 0xFFFFFFFFFF)
    return bits - (1 << 64) if bits >> 63 else bits


def iso_date(digits: str) -> str:
    """WARC-Date of an ARC date of 14 digits, or of 12 without seconds; anything else is the epoch."""
    d = digits if re.fullmatch(r"\d{14}", digits) else digits + "00" if re.fullmatch(r"\d{12}", digits) else DEFAULT_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def http_block(page: int | None, payload: bytes) -> bytes:
    own = NO_PAGE if page is None else b"%d" % page
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: %b\r\nContent-Length: %d\r\n\r\n" % (own, len(payload)) + payload


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head, with its empty line, and the payload of an HTTP response; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, n) for at, n in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if at >= 0]
    at, n = min(ends, default=(len(block), 0))
    return block[: at + n], block[at + n :]


def arc_version_block(version: str, name: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    first = {"URL": f"filedesc://{name}", "IP-address": DEFAULT_IP, "Archive-date": DEFAULT_DATE, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(first[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def arc_record(version: str, url: str, block: bytes, name: str) -> bytes:
    fields = {"URL": _GAP.sub("%20", url) or "-", "IP-address": DEFAULT_IP, "Archive-date": DEFAULT_DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


def _inflated(data: bytes) -> bytes:
    """The bytes of a file of gzip members, or the file as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record after the version block; the block's version names the fields.

    Empty lines between records are skipped. A line that does not have its version's fields or a whole length, or a
    length beyond the end of the file, raises ValueError: what follows could not be told apart.
    """
    at, fields = 0, None
    while at < len(data):
        is_first = fields is None
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].rstrip(b"\r")
        at = len(data) if end < 0 else end + 1
        if not line:
            continue
        parts = line.decode("utf-8", "replace").split(" ")
        if fields is None:  # the version block's own line has the length last in either version
            version = data[at : data.find(b"\n", at)].split(b" ")[0].decode()
            if not parts[0].startswith("filedesc:") or version not in ARC_FIELDS:
                raise ValueError(f"not an ARC version block: {line[:80]!r}")
            fields = ARC_FIELDS[version]
        if len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        size = int(parts[-1])
        if at + size > len(data):
            raise ValueError(f"a record of {size} bytes ends behind its file")
        if not is_first:  # a later URL of filedesc: is a capture
            yield dict(zip(fields, parts, strict=True)), data[at : at + size]
        at += size


def warc_record(kind: str, own_id: str, url: str, date: str, head: bytes, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    block = head + payload if kind == "response" else head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own_id}>", f"WARC-Date: {iso_date(date)}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
    return CRLF.join([*(x.encode() for x in lines), b"Content-Length: %d" % len(block), b"", block])


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header by lower-case name, block) of each record, split by Content-Length; ValueError for anything else."""
    at = 0
    while at < len(data):
        if data.startswith(CRLF, at):
            at += 2
            continue
        end = data.find(CRLF + CRLF, at)
        lines = data[at : max(at, end)].split(CRLF)
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {data[at : at + 80]!r}")
        header = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        at = end + 4
        size = int(header["content-length"])
        if at + size > len(data):
            raise ValueError(f"a record of {size} bytes ends behind its file")
        yield header, data[at : at + size]
        at += size


def _files(rows: DataFrame) -> int:
    return max(1, round((rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0) / FILE_BYTES))


def write_arc(pages: DataFrame, path: str, scratch: Scratch) -> None:
    """Writes pages (page_id long, url string, html string) as gzipped ARC files, every other of version 2."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = ("1", "2")[part % 2], f"part-{part}.arc"
        first = [arc_version_block(version, name)[:-1]]  # the writer ends each row with a line end
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            out = [arc_record(version, url or "", http_block(page, (html or "").encode()), name) for page, url, html in rows]
            yield pa.RecordBatch.from_arrays([pa.array(first + out, pa.binary())], ["record"])
            first = []

    rows = pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html")
    # Not by page_id alone: rows without one, or that repeat one, would meet in one file.
    rows = rows.repartition(_files(rows), F.xxhash64("page_id", F.monotonically_increasing_id())).mapInArrow(records, "record binary").select(F.col("record").cast("string"))
    scratch.write(rows.write.option("compression", "gzip").option("lineSep", "\n"), path, "text")


def read_arc(spark, path: str, with_payload: bool) -> DataFrame:
    """(key, page, place, url, date, digest, size) of each record under path, with its head and payload if wanted.

    page is the id from the block's X-Page-Id, else null; key is it, else 64 bits of a digest of URL, date and block. place
    tells records apart by where they stand.
    """
    schema = "key long, page long, place long, url string, date string, digest string, size long" + ", head binary, payload binary" * with_payload

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns = [[] for _ in names]
                held = 0
                for number, (f, block) in enumerate(parse_arc(_inflated(data.as_py()))):
                    head, payload = split_http(block)
                    page = _PAGE.search(head)
                    key = int(page[1]) if page else int.from_bytes(hashlib.sha256(f"{f['URL']} {f['Archive-date']} ".encode() + block).digest()[:8], "big", signed=True)
                    row = (key, int(page[1]) if page else None, record_place(file, number), f["URL"], f["Archive-date"], payload_digest(payload), len(payload), head, payload)
                    for c, v in zip(columns, row, strict=False):
                        c.append(v)
                    held += len(block) if with_payload else 64
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                        columns, held = [[] for _ in columns], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["key", "page", "place", "url", "date", "digest", "size", "head", "payload"][: 7 + 2 * with_payload]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()][: len(names)]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, schema)


def convert_arc(spark, arc: str, warc: str, scratch: Scratch, least_revisit: int = LEAST_REVISIT) -> None:
    """Converts the ARC files under arc to gzipped WARC files under warc, a record for each record.

    Of captures whose payloads of least_revisit bytes or more are equal, the one with the smallest page id (without any,
    the smallest key) is a response and the others revisit it. Every record has an id of its own. Keys of copies are found first from digests alone, and payloads are read again only to
    be written: they are not shuffled unless the table of copies is too large to send to the tasks.
    """
    seen = read_arc(spark, arc, False).where(F.col("size") >= least_revisit)
    firsts = seen.groupBy("digest", "size").agg(F.min(F.struct(F.col("page").isNull(), "key", "place")).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", "size", F.col("f.key").alias("first"), F.col("f.place").alias("first_place"))
    firsts = scratch.keep(firsts)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "place", "url", "date", "head", "payload", "digest", "first", "first_place")), strict=True)
            out = []
            for key, place, url, date, head, payload, digest, first, first_place in rows:
                revisit = first is not None and first != key
                out.append(warc_record("revisit" if revisit else "response", record_id(key, place), url, date, head, payload, digest, record_id(first, first_place) if revisit else None))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = read_arc(spark, arc, True).join(firsts, ["digest", "size"], "left")
    rows = rows.select("key", "place", "url", "date", "head", "payload", "digest", "first", "first_place").mapInArrow(records, "record binary").select(F.col("record").cast("string"))
    scratch.write(rows.write.option("compression", "gzip").option("lineSep", "\r\n\r\n"), warc, "text")


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, date) of each record under path."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for h, block in parse_warc(_inflated(data.as_py())):
                    response = h["warc-type"] == "response"
                    payload = split_http(block)[1]
                    digest = payload_digest(payload) if response else h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-payload-digest"] != f"sha1:{digest}" or h["warc-block-digest"] != f"sha1:{payload_digest(block)}":
                        raise ValueError(f"{h['warc-record-id']}: its digest is not that of its bytes")
                    refers = None if response else record_key(h["warc-refers-to"])
                    own = None if _NO_PAGE.search(split_http(block)[0]) else record_key(h["warc-record-id"])
                    rows.append((own, len(payload) if response else int(h["x-payload-length"]), digest, h["warc-type"], refers, h["warc-target-uri"], h["warc-date"]))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, schema)


def archive_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, date) for every row of pages.

    pages (page_id long, url string, html string) are written as ARC archives, converted to WARC, and read back. A null
    html is like an empty one, a null url is written as a dash; white space and control characters in a url are escaped.
    Rows that repeat a page_id with equal html are all responses. A row without a page_id keeps none and is a response only
    if no page has its html; of such rows refers_to is the number that the response's record id holds. Other columns are ignored; an empty table gives an
    archive without captures and no rows.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc, scratch)
    convert_arc(spark, arc, warc, scratch)
    scratch.delete(arc)
    return read_warc(spark, warc)
