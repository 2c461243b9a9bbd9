"""Legacy web archives to WARC: write ARC files, convert them, read the WARC files back.

An ARC file begins with a version block that names the fields of the header lines that follow; version 1 has five
fields, version 2 ten. The converter goes by that line and by each record's declared length, and makes WARC records with
identifiers, dates, types and digests of their own. Records whose payload another one holds become revisits of it.

All files are written by Spark's text writer (a record is a row, what stands between records is the line separator), so
a lost task leaves nothing behind, and read by Spark's binary reader, so they may lie in any store that Spark reads.
A file holds at most ``RECORDS_PER_FILE`` records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigscope.llm.tables import materialize

RECORDS_PER_FILE = 8192
#: The field names of ARC header lines by version, and the revisit profile of WARC 1.1.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_DATE = "19700101000000"
_INDEX = ("path string, place int, record_id string, key string, url string, date string, payload_bytes long, "
          "payload_digest string")
_WARC = ("record_id string, record_type string, date string, url string, key long, payload_bytes long, "
         "payload_digest string, refers_to_id string, refers_to long, payload binary, sound boolean")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC -----------------------------------------------------------------------------------------------------------


def version_block(name: str, version: int, date: str = _NO_DATE) -> bytes:
    """The first record of an ARC file, without the line feed after it."""
    body = f"{version} 0 rigscope\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else [])]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def arc_record(url: str | None, key, payload: bytes, version: int, name: str, date: str = _NO_DATE) -> bytes:
    """A record for a page: header line, HTTP head, payload. White space in a URL is percent-escaped, a null or empty
    URL is ``-``; the row's key goes along in the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    if key is not None:
        head += f"X-Record-Key: {key}\r\n"
    block = head.encode() + b"\r\n" + payload
    place = re.sub(r"[\s\x00-\x1f]", lambda m: quote(m[0], safe=""), url) if url else "-"
    fields = [place, "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", digest_of(payload), "-", "0", name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block


def arc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an ARC file, the version block first. Fields are those that the file's own
    version block names; a header line's last fields are taken from its end, because old URLs hold blanks."""
    names = None
    while line := stream.readline():
        if not line.strip():
            continue
        if names is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError(f"an ARC file begins with a version block, not with {line[:60]!r}")
            length = int(line.rsplit(b" ", 1)[1])
            block = stream.read(length)
            version, fields = block.decode().split("\n")[:2]
            names = fields.split(" ")
            if int(version.split(" ")[0]) not in ARC_FIELDS or names[-1] != "Archive-length":
                raise ValueError(f"unknown version of an ARC file: {version!r}, {fields!r}")
            if len(line.split(b" ")) == 5:           # a short first line, whatever the version
                first = ARC_FIELDS[1].split(" ")
            else:
                first = names
            yield dict(zip(first, line.decode().rstrip("\r\n").rsplit(" ", len(first) - 1))) | {"version": version}, block
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        fields = dict(zip(names, values))
        block = stream.read(int(fields["Archive-length"]))
        if len(values) < len(names) or len(block) < int(fields["Archive-length"]):
            raise ValueError(f"cut off ARC record: {line[:100]!r}")
        yield fields, block


def warc_date(date: str | None) -> str:
    """ISO date of 14 (or fewer) digits; the missing ones are the least possible."""
    digits = date if date and re.fullmatch(r"\d{4,14}", date) else _NO_DATE
    digits += "00000101000000"[len(digits):]
    y, mo, d, h, mi, s = digits[:4], *(digits[i:i + 2] for i in range(4, 14, 2))
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


class Entry:
    """What a WARC record needs to know of an ARC record."""

    def __init__(self, fields: dict[str, str], block: bytes, name: str, place: int):
        self.url, self.mime = fields["URL"], fields["Content-type"]
        self.date = warc_date(fields["Archive-date"])
        self.ip = fields["IP-address"]
        self.block = block
        self.http = block.startswith(b"HTTP/")
        cut = block.find(b"\r\n\r\n") + 4 if self.http else 0
        self.head, self.payload = (block[:cut], block[cut:]) if cut >= 4 else (b"", block)
        key = re.search(rb"\r\nX-Record-Key: ([^\r\n]*)", self.head)
        self.key = key[1].decode() if key else None
        self.digest = digest_of(self.payload)
        self.record_id = str(uuid.UUID(bytes=hashlib.sha1(f"{name}\n{place}\n{self.url}\n{self.date}".encode())
                                       .digest()[:16], version=5))


def _opened(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)


def entries(content: bytes) -> Iterator[tuple[int, Entry | bytes]]:
    """(place, record) of an ARC file; place 0 is the version block."""
    name = ""
    for place, (fields, block) in enumerate(arc_records(_opened(content))):
        if place == 0:
            name = fields["URL"]
            yield 0, f"{name}\n".encode() + block
        else:
            yield place, Entry(fields, block, name, place)


def _arc_rows(version: int | None, records_per_file: int, date: str):
    def rows(batches):
        """Records of a partition, a version block before each file's worth."""
        part, n, name, kind = TaskContext.get().partitionId(), 0, "", 1
        for batch in batches:
            out = []
            for key, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if n % records_per_file == 0:
                    kind = version or 1 + part % 2
                    name = f"pages-{part:06d}-{n // records_per_file:05d}.arc"
                    out.append(version_block(name, kind, date))
                    n += 1
                out.append(arc_record(url, key, (payload or "").encode(), kind, name, date))
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return rows


def _write(records: DataFrame, path: str, separator: str, records_per_file: int) -> None:
    (records.select(F.col("value").cast("string")).write.option("lineSep", separator).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path))


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
              version: int | None = None, records_per_file: int = RECORDS_PER_FILE, date: str = _NO_DATE) -> None:
    """Write a row of ``pages`` as a record of compressed ARC files; a null payload is empty. Without a ``version`` the
    files of every other partition are of version 2."""
    if records_per_file < 2:
        raise ValueError("a file holds a version block and at least one record")
    rows = pages.select(key_col, url_col, payload_col).mapInArrow(_arc_rows(version, records_per_file, date), "value binary")
    _write(rows, path, "\n", records_per_file)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# --- WARC ----------------------------------------------------------------------------------------------------------


def _warc(kind: str, record_id: str, date: str, block: bytes, content_type: str, more: list[tuple[str, object]]) -> bytes:
    """A WARC record without the two line ends after it."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), *more,
              ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", content_type),
              ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def warc_record(entry: Entry, refers: dict | None) -> bytes:
    """A response or resource with the entry's block, or a revisit of ``refers`` with its HTTP head alone."""
    more = [("WARC-Target-URI", None if entry.url == "-" else entry.url),
            ("WARC-IP-Address", None if entry.ip == "0.0.0.0" else entry.ip), ("X-Record-Key", entry.key),
            ("X-Payload-Bytes", len(entry.payload)), ("WARC-Payload-Digest", f"sha1:{entry.digest}")]
    kind = "response" if entry.http else "resource"
    mime = "application/http;msgtype=response" if entry.http else entry.mime
    block = entry.block
    if refers:
        kind, block = "revisit", entry.head
        more += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers['record_id']}>"),
                 ("WARC-Refers-To-Target-URI", None if refers["url"] == "-" else refers["url"]),
                 ("WARC-Refers-To-Date", refers["date"]), ("X-Refers-To-Key", refers["key"])]
    return _warc(kind, entry.record_id, entry.date, block, mime, more)


def _index(batches):
    """A row for each ARC record, without its payload."""
    for batch in batches:
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            rows = [(path, place, e.record_id, e.key, e.url, e.date, len(e.payload), e.digest)
                    for place, e in entries(content) if place]
            kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                             [x.split()[0] for x in _INDEX.split(", ")])


def _converted(batches):
    """WARC records of ARC files. ``revisits`` has the records of the file that revisit another one."""
    for batch in batches:
        for content, revisits in zip(batch.column(0), batch.column(1)):
            known = {r["place"]: r for r in revisits.as_py() or ()}
            out, size = [], 0
            for place, e in entries(content.as_py()):
                if place:
                    record = warc_record(e, known.get(place))
                else:
                    name = hashlib.sha1(e).digest()[:16]
                    record = _warc("warcinfo", str(uuid.UUID(bytes=name, version=5)), warc_date(None), e, "text/plain", [])
                out.append(record)
                size += len(record)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0,
            records_per_file: int = RECORDS_PER_FILE) -> None:
    """Convert the ARC files under ``arc_path`` to WARC files.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest key (a number; of equal keys
    the one with the largest identifier) is kept whole, the others revisit it. Only digests are shuffled to find them,
    then each file meets its own revisits: at most ``records_per_file`` rows.
    """
    files = _files(spark, arc_path)
    index = materialize(files.mapInArrow(_index, _INDEX).withColumn("number", F.expr("try_cast(key AS bigint)")), "arc-index")
    large = index.where(F.col("payload_bytes") >= min_bytes)
    order = F.struct("number", "record_id", "key", "url", "date")
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.max(order).alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1").drop("n"), "arc-firsts")
    revisits = large.join(first, ["payload_digest", "payload_bytes"]).where("record_id <> first.record_id")
    revisits = revisits.groupBy("path").agg(F.collect_list(
        F.struct("place", "first.record_id", "first.key", "first.url", "first.date")).alias("revisits"))
    revisits = materialize(revisits, "arc-revisits")
    joined = files.join(revisits, "path", "left").select("content", "revisits")
    _write(joined.mapInArrow(_converted, "value binary"), warc_path, "\r\n\r\n", records_per_file)


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file, by declared lengths; field names in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a WARC record begins with its version, not with {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"cut off WARC record: {fields}")
        yield fields, block


def _read_rows(batches):
    bare = lambda x: x and x.removeprefix("<urn:uuid:").removesuffix(">").removeprefix("sha1:")
    number = lambda x: int(x) if x and re.fullmatch(r"-?\d+", x) else None
    names = [x.split()[0] for x in _WARC.split(", ")]
    kinds = [*[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
    make = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for f, block in warc_records(_opened(content.as_py())):
                kind, cut = f["warc-type"], block.find(b"\r\n\r\n") + 4
                payload = None
                if kind in ("response", "resource"):
                    payload = block[cut:] if block.startswith(b"HTTP/") else block
                sound = bare(f["warc-block-digest"]) == digest_of(block) and (
                    payload is None or bare(f.get("warc-payload-digest")) == digest_of(payload))
                rows.append((bare(f["warc-record-id"]), kind, f["warc-date"], f.get("warc-target-uri"),
                             number(f.get("x-record-key")), number(f.get("x-payload-bytes")),
                             bare(f.get("warc-payload-digest")), bare(f.get("warc-refers-to")),
                             number(f.get("x-refers-to-key")), payload, sound))
                size += len(block)
                if size > 1 << 22:
                    yield make(rows)
                    rows, size = [], 0
            yield make(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files under ``path``, their payloads included; ``sound`` if the digests agree.
    Revisits have the length and digest of the payload that they don't hold."""
    return _files(spark, path).select("content").mapInArrow(_read_rows, _WARC)


def op5_sql() -> str:
    """DuckDB SQL for ``queries.op5_warc``."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - (i % 4) * 5)) & 31) AS BIGINT) + 1, 1)), '')
    AS payload_digest
  FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM m
"""
