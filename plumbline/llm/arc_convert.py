"""Legacy archive converter: ARC records to WARC records.

An ARC archive starts with a version block whose last line names the fields
of the header lines that follow (five in version 1, ten in version 2).  Each
record is a header line and as many bytes as it declares.  The converter
gives every record the identifiers, timestamp, type and digests that a WARC
record of the same capture would carry.

Archives in any store are read as binary files and converted by
:func:`convert_archives`; :func:`archive_pages` makes ARC records of a table
of pages first.  WARC archives are written by Spark's own text writer, a row
for every few megabytes of records and the record separator as line end, so
files are bounded by bytes and a task that is run again replaces what it
wrote.  They are read back by declared lengths from standard headers alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import keep, new_path
from .batches import texts_of

# The field lists of ARC header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\r\n\r\n"
#: Payloads of so many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of records that are converted, and written as one row, at a time.
ARCHIVE_BYTES = 4 << 20
#: Such rows of an archive file: a file has so much, and one record over.
FILE_ROWS = 8
#: Revisits that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: The first 48 bits of record ids made from page ids.
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:plumbline:arc").int >> 80
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ARC_DATE = "20200101000000"


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The entity body of an HTTP response, else the whole block."""
        if self.block.startswith(b"HTTP/"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive after its version block.

    Broken archives raise ``ValueError`` with the place: a header line with
    the wrong number of fields, or a length that runs past the end.
    """
    at, version, names = 0, 0, []
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # records end with a line feed
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if names and len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields in place of {len(names)} at byte {at}")
        if not parts[-1].isdigit():
            raise ValueError(f"no length at byte {at}")
        start, stop = end + 1, end + 1 + int(parts[-1])
        if stop > len(data):
            raise ValueError(f"record at byte {at} runs past the end")
        block = data[start:stop]
        at = stop
        if not names:
            if not line.startswith("filedesc://"):
                raise ValueError("an archive starts with its version block")
            about = block.decode("utf-8", "replace").splitlines()
            version = int(about[0].split(" ")[0])
            names = (about[1] if len(about) > 1 else ARC_FIELDS[version]).split(" ")
            continue
        yield ArcRecord(version, dict(zip(names, parts, strict=True)), block)


def build_arc(version: int, records: list[tuple[str, str, bytes]]) -> bytes:
    """An archive of ``(url, content type, block)`` records."""
    about = f"{version} 0 plumbline\n{ARC_FIELDS[version]}\n".encode()
    out = [f"filedesc://pages.arc 0.0.0.0 {_ARC_DATE} text/plain {_extra(version, b'')}{len(about)}\n".encode(), about, b"\n"]
    for url, kind, block in records:
        out += [f"{_clean_url(url)} 0.0.0.0 {_ARC_DATE} {kind} {_extra(version, block)}{len(block)}\n".encode(), block, b"\n"]
    return b"".join(out)


def _extra(version: int, block: bytes) -> str:
    return "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - 0 pages.arc "


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    """A version 8 UUID that spells the page id, so a reader gets it back from the standard header."""
    low = (page or 0) & (1 << 64) - 1
    number = _NAMESPACE << 80 | 8 << 76 | (page is None) << 66 | low >> 62 << 64 | 2 << 62 | low & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(record: str | None) -> int | None:
    """The page id that :func:`record_id` spelt; null for other records' ids."""
    try:
        number = uuid.UUID((record or "").removeprefix("<").removesuffix(">")).int
    except ValueError:
        return None
    if number >> 80 != _NAMESPACE or number >> 76 & 15 != 8 or number >> 66 & 1:
        return None
    low = (number >> 64 & 3) << 62 | number & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def warc_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss``, cut short or not, as a WARC timestamp."""
    full = "00000101000000"
    d = arc_date + full[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, own_id: str, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the separator at its end.

    With ``refers_to``, another record's id, URI and date, it is a revisit
    that keeps only the HTTP head.
    """
    payload, block = record.payload, record.block
    is_http = block.startswith(b"HTTP/")
    kind = "revisit" if refers_to is not None else "response" if is_http else "resource"
    kept = block[: len(block) - len(payload)] if refers_to is not None else block
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", own_id),
        ("WARC-Date", warc_date(record.fields["Archive-date"])),
        ("WARC-Target-URI", record.fields["URL"]),
        ("WARC-IP-Address", record.fields["IP-address"]),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(kept)),
        ("Content-Type", "application/http; msgtype=response" if is_http else record.fields["Content-type"]),
        ("Content-Length", str(len(kept))),
    ]
    if refers_to is not None:
        names = ("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date")
        headers += [("WARC-Profile", REVISIT_PROFILE), *zip(names, refers_to, strict=True)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + kept


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield headers, data[start:stop]
        at = stop + 4


def _clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)


def _page_url(page: int | None, url: str | None) -> str:
    return _clean_url(url) if url else f"urn:page:{page}"


def _written(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``ARCHIVE_BYTES`` of records with the separator between them."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.encode().join(held)], pa.binary())], ["record"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.encode().join(held)], pa.binary())], ["record"])


def _convert_batches(batches):
    def convert(rows):
        """Through an ARC archive of each version, in memory."""
        for version in (1, 2):
            own = [r for r in rows if (r[0] or 0) % 2 == version - 1]
            archive = build_arc(version, [(_page_url(*r[:2]), "text/html", _HEAD + r[2]) for r in own])
            for (page, _, _, refers, refers_url), record in zip(own, parse_arc(archive), strict=True):
                other = None
                if refers is not None:
                    other = (record_id(refers), _page_url(refers, refers_url), warc_date(_ARC_DATE))
                yield to_warc(record, record_id(page), other)

    def records():
        rows, held = [], 0
        for batch in batches:
            others = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for page, url, refers, refers_url, body in zip(*others, texts_of(batch.column(2)), strict=True):
                rows.append((page, url, body or b"", refers, refers_url))
                held += len(body or b"")
                if held >= ARCHIVE_BYTES:
                    yield from convert(rows)
                    rows, held = [], 0
        yield from convert(rows)

    yield from _written(records())


_READ = (
    "record_id string, warc_type string, date string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to string, page_id long, refers_to_page long"
)


def _read_batches(batches):
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _READ.split(", ")]
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for headers, block in parse_warc(data.as_py()):
                kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                size = digest = None
                if kind == "revisit":
                    declared = headers.get("WARC-Payload-Digest", "")
                    digest = base64.b32decode(declared[5:]).hex() if declared.startswith("sha1:") else None
                else:
                    is_http = headers.get("Content-Type", "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if is_http else block
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                own = headers["WARC-Record-ID"]
                rows.append((own, kind, headers.get("WARC-Date"), headers.get("WARC-Target-URI"), digest, size, refers, page_of(own), page_of(refers)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, payload_digest, refers_to, refers_url)`` of pages whose payload another record holds."""
    body = F.coalesce(F.col("html"), F.lit(""))
    digests = keep(
        pages.where(F.octet_length(body) >= REVISIT_BYTES).select("page_id", "url", F.sha1(body.cast("binary")).alias("payload_digest")),
        "payload-digests",
    )
    holders = (
        digests.where("page_id is not null")
        .groupBy("payload_digest")
        .agg(F.max(F.struct("page_id", "url")).alias("holder"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", F.col("holder.page_id").alias("refers_to"), F.col("holder.url").alias("refers_url"))
    )
    return digests.drop("url").join(holders, "payload_digest").where("page_id <> refers_to").distinct()


def _write(records: DataFrame, path: str) -> None:
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option(
        "maxRecordsPerFile", FILE_ROWS
    ).text(path)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the pages as ARC records, converts them and stores WARC archives in ``path``.

    Which pages are revisits is settled on digests; the answer is broadcast
    up to ``BROADCAST_ROWS`` of them, and joined to the pages beyond.
    """
    slim = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    repeated = keep(revisits(slim), "revisits")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    linked = slim.withColumn(
        "payload_digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    ).join(repeated, ["page_id", "payload_digest"], "left")
    _write(linked.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(_convert_batches, "record binary"), path)


def _inflated(data: bytes) -> bytes:
    """The bytes of a file, which may be compressed record by record."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _key_of(path: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{n}')}>"


def _index_batches(batches):
    names, types = ["path", "n", "id", "uri", "date", "digest", "size"], [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for n, r in enumerate(parse_arc(_inflated(data.as_py()))):
                rows.append((path, n, _key_of(path, n), r.fields["URL"], warc_date(r.fields["Archive-date"]), _sha1(r.payload), len(r.payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _convert_files(batches):
    def records():
        for batch in batches:
            for path, data, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                known = {x["n"]: (x["id"], x["uri"], x["date"]) for x in listed.as_py() or []}
                for n, record in enumerate(parse_arc(_inflated(data.as_py()))):
                    yield to_warc(record, _key_of(path, n), known.get(n))

    yield from _written(records())


def convert_archives(spark: SparkSession, arc_path: str, path: str, glob: str = "*.arc*") -> None:
    """Converts the ARC archives in ``arc_path``, compressed or not, to WARC archives in ``path``.

    Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with
    the largest id is kept whole, and others revisit it.  Files are read
    twice: for their digests and for their records.  A broken archive fails
    with the place; a folder without archives gives one without records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(arc_path)
    files = files.select("path", "content")
    index = keep(
        files.mapInArrow(_index_batches, "path string, n long, id string, uri string, date string, digest string, size long"), "arc-index"
    )
    large = index.where(F.col("size") >= REVISIT_BYTES)
    holders = large.groupBy("digest").agg(F.max(F.struct("id", "uri", "date")).alias("held"), F.count(F.lit(1)).alias("c")).where("c > 1")
    listed = (
        large.join(holders, "digest")
        .where(F.col("id") != F.col("held.id"))
        .groupBy(F.col("path").alias("file"))
        .agg(F.collect_list(F.struct("n", "held.id", "held.uri", "held.date")).alias("listed"))  # of one file
    )
    joined = files.join(keep(listed, "arc-revisits"), F.col("path") == F.col("file"), "left")
    _write(joined.select("path", "content", "listed").mapInArrow(_convert_files, "record binary"), path)


def read_warc(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """One row for each record of the archives in ``path``, of whatever origin, from standard headers.

    ``payload_digest`` is hexadecimal; a revisit's is the declared one, and
    its ``payload_bytes`` is null, since its payload isn't there.
    ``page_id`` and ``refers_to_page`` are null for ids that spell no page.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("content").mapInArrow(_read_batches, _READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Converts every page to a WARC record and reads the archives back.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.  A
    null html is an empty payload, a very long one a record of its own file
    row; a null or odd url is replaced or escaped; a null id takes no part in
    revisits; rows that repeat an id and a payload hold one each; other
    columns, whatever their names, are not read; an empty table gives an
    empty one.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    found = keep(
        read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "warc_type", "refers_to_page"), "archived"
    )
    # a revisit's payload is as long as that of the record with its digest
    whole = found.where("warc_type <> 'revisit'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("size"))
    again = found.where("warc_type = 'revisit'").join(whole, F.col("payload_digest") == F.col("d"))
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.col("refers_to_page").alias("refers_to")]
    return (
        found.where("warc_type <> 'revisit'")
        .select(columns)
        .unionByName(again.drop("payload_bytes").withColumnRenamed("size", "payload_bytes").select(columns))
    )
