"""Legacy web archives (ARC 1 and 2) converted to WARC.

An ARC file starts with a version block whose body names the version; that decides how many fields
the header line of each record has (5 in version 1, 10 in version 2). The last field is the declared
length of the body, and nothing but that length ends a record. Each record becomes a WARC record:

* identifier: a UUID made from the target URI, the date and the place in the ARC file;
* date: the 14-digit ARC date in ISO form;
* type: ``response``, or ``revisit`` if an earlier record has the same payload;
* digests: SHA-1 in base 32 of the payload and of the block.

Archives travel as rows ``(archive, content)`` whose ``content`` is a complete ``.arc.gz`` or
``.warc.gz`` file of about ``ARCHIVE_BYTES`` before compression (ARC: one gzip member, WARC: one a
record), written by Spark's own Parquet writer to the shared folder, so a lost task leaves nothing half-written behind.
``export_files`` puts them into a folder as plain files.

Payloads are equal if length, SHA-1 and SHA-256 are. Only these digests are shuffled by payload; the
payloads stay in their archives, so a payload that a third of all pages share meets in no task.

Defined results: null html is an empty payload; a null url is ``urn:none``; a null ``page_id`` is later
than any other and never referred to unless all are null; rows that repeat the ``page_id`` of the
response with the same payload are responses too; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.text import utf8
from ledgerlens.session import cut_lineage, stage_path

ARCHIVE_BYTES = 8 << 20
MIN_REVISIT_BYTES = 0
CAPTURE_DATE = "20000101000000"
_LEVEL = 4
_STEP = 8192

# The field names of ARC header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def compressor():
    """Of one gzip member, with no time stamp."""
    return zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)


def member(data: bytes) -> bytes:
    c = compressor()
    return c.compress(data) + c.flush()


def members(content: bytes) -> Iterator[bytes]:
    """Uncompressed gzip members, fed in small steps: what a member leaves over is never much."""
    at = 0
    while at < len(content):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(content):
            parts.append(d.decompress(content[at:at + _STEP]))
            at += _STEP
        at = min(at, len(content)) - len(d.unused_data)
        yield b"".join(parts) + d.flush()


def uri(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "urn:none"


# --- ARC -----------------------------------------------------------------------------------------

def arc_record(version: int, url: str, date: str, mime: str, body: bytes, ip: str = "0.0.0.0",
               offset: int = 0, filename: str = "-") -> bytes:
    fields = [url, ip, date, mime]
    if version == 2:
        fields += ["200", base32_sha1(body), "-", str(offset), filename]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_start(version: int, filename: str, date: str) -> bytes:
    body = f"{version} 0 ledgerlens\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{filename}", date, "text/plain", body, filename=filename)


class ArcError(ValueError):
    pass


def read_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file: ``offset, url, ip, date, mime, status, body``.

    ``offset`` is the place of the record in the uncompressed file. Records may be spread over gzip
    members in any way, or not be compressed at all.
    """
    data = b"".join(members(content)) if content[:2] == b"\x1f\x8b" else content
    names: list[str] = []
    at = 0
    while at < len(data):
        if data[at:at + 1] in b"\r\n":  # blank lines between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError("header line without end")
        fields = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        length = int(fields[-1]) if fields[-1].isdigit() else -1
        start, stop = end + 1, end + 1 + length
        if length < 0 or stop > len(data):
            raise ArcError("declared length is missing or too large")
        body = data[start:stop]
        if not names:
            if not fields[0].startswith("filedesc://"):
                raise ArcError("no version block")
            names = ARC_FIELDS[int(body.split(None, 1)[0])].split(" ")
        else:
            if len(fields) != len(names):
                raise ArcError("header line has the fields of another version")
            own = dict(zip(names, fields))
            yield {"offset": at, "url": own["URL"], "ip": own["IP-address"], "date": own["Archive-date"],
                   "mime": own["Content-type"], "status": own.get("Result-code"), "body": body}
        at = stop


def http_response(payload: bytes, headers: dict[str, str]) -> bytes:
    lines = ["HTTP/1.1 200 OK", *(f"{k}: {v}" for k, v in headers.items()), "", ""]
    return "\r\n".join(lines).encode() + payload


def split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), the header bytes, and the payload."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or not mark:
        return {}, b"", body
    lines = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}, head + mark, payload


def write_arc(pages: DataFrame, path: str, date: str = CAPTURE_DATE) -> DataFrame:
    """Pages ``(page_id, url, html)`` as ARC files, versions 1 and 2 by turns; rows ``(archive, content)``.

    The page's id is the HTTP header ``X-Page-Id`` of the captured response.
    """
    def run(batches):
        task, done, parts, raw = TaskContext.get().partitionId(), 0, [], 0

        def close():
            return pa.RecordBatch.from_pydict({"archive": [name], "content": [b"".join(parts) + gzip.flush()]})

        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if not parts:
                    version = 1 + (task + done) % 2
                    name = f"part-{task:05d}-{done:05d}.arc.gz"
                    start = arc_start(version, name, date)
                    gzip = compressor()
                    parts, raw = [gzip.compress(start)], len(start)
                head = {"Content-Type": "text/html; charset=utf-8"}
                if page is not None:
                    head["X-Page-Id"] = str(page)
                record = arc_record(version, uri(url), date, "text/html", http_response(utf8(html), head),
                                    offset=raw, filename=name)
                parts.append(gzip.compress(record))
                raw += len(record)
                if raw >= ARCHIVE_BYTES:
                    yield close()
                    done, parts = done + 1, []
        if parts:
            yield close()

    out = pages.select("page_id", "url", "html").mapInArrow(run, "archive string, content binary")
    out.write.option("compression", "none").parquet(path)
    return pages.sparkSession.read.parquet(path)


def arc_records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of ARC files: its place, header, payload and the payload's digests."""
    schema = ("archive string, offset long, url string, ip string, date string, mime string, page_id long, "
              "head binary, payload_bytes long, sha1 string, sha256 binary")
    names = [c.split()[0] for c in schema.split(", ")] + (["payload"] if payload else [])

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                out = {n: [] for n in names}
                for r in read_arc(content):
                    fields, head, own = split_http(r["body"])
                    page = fields.get("x-page-id", "")
                    values = (name, r["offset"], r["url"], r["ip"], r["date"], r["mime"],
                              int(page) if page.lstrip("-").isdigit() else None, head, len(own),
                              base32_sha1(own), hashlib.sha256(own).digest(), own)
                    for n, v in zip(names, values):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema += ", payload binary" if payload else ""
    target = to_arrow_schema(_parse_datatype_string(schema))
    return archives.select("archive", "content").mapInArrow(run, schema)


# --- WARC ----------------------------------------------------------------------------------------

def warc_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()),
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def record_id(url: str, date: str, archive: str, offset: int) -> str:
    digest = hashlib.sha1(f"{archive}\n{offset}\n{date}\n{url}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=digest[:16], version=5)}>"


def iso(date: str) -> str:
    """ISO form of an ARC date; missing digits (12-digit dates, years alone) are the earliest."""
    d = (date if date.isdigit() else "")[:14]
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(archives: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """ARC files to WARC files, one for one, written to ``path``; rows ``(archive, content)``.

    Revisits are decided on digests alone; each archive then gets the list of its own, which is no
    longer than the archive.
    """
    same = ["payload_bytes", "sha1", "sha256"]
    place = ["page_id", "archive", "offset", "url", "date"]
    digests = cut_lineage(arc_records(archives, payload=False).select(*place, *same)
                          .where(F.col("payload_bytes") >= min_revisit_bytes))
    first = (digests.where(F.col("page_id").isNotNull()).groupBy(*same)
             .agg(F.min(F.struct(*place)).alias("first")))
    revisits = (digests.join(first, same).where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
                .groupBy("archive").agg(F.collect_list(F.struct("offset", "first")).alias("again")))

    def convert_one(archive: str, content: bytes, again: dict[int, dict]) -> tuple[str, bytes]:
        name = archive.removesuffix(".gz").removesuffix(".arc") + ".warc.gz"
        info = b"software: ledgerlens\r\nformat: WARC File Format 1.1\r\n"
        parts = [member(warc_record("warcinfo", {
            "WARC-Record-ID": record_id(name, CAPTURE_DATE, name, 0), "WARC-Date": iso(CAPTURE_DATE),
            "WARC-Filename": name, "Content-Type": "application/warc-fields"}, info))]
        for r in read_arc(content):
            fields, head, payload = split_http(r["body"])
            first = again.get(r["offset"])
            block = r["body"] if first is None else head
            headers = {
                "WARC-Record-ID": record_id(r["url"], r["date"], archive, r["offset"]),
                "WARC-Date": iso(r["date"]), "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"],
                "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
                "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
                "Content-Type": "application/http; msgtype=response" if head else r["mime"],
                "X-Payload-Length": str(len(payload))}
            if "x-page-id" in fields:
                headers["X-Page-Id"] = fields["x-page-id"]
            if first is not None:
                headers |= {
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                    "WARC-Refers-To": record_id(first["url"], first["date"], first["archive"], first["offset"]),
                    "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": iso(first["date"]),
                    "X-Refers-To-Page-Id": str(first["page_id"])}
            parts.append(member(warc_record("response" if first is None else "revisit", headers, block)))
        return name, b"".join(parts)

    def run(batches):
        for batch in batches:
            for archive, content, again in zip(*(c.to_pylist() for c in batch.columns)):
                name, out = convert_one(archive, content, {x["offset"]: x["first"] for x in again or []})
                yield pa.RecordBatch.from_pydict({"archive": [name], "content": [out]})

    archives.join(revisits, "archive", "left").select("archive", "content", "again").mapInArrow(
        run, "archive string, content binary").write.option("compression", "none").parquet(path)
    return archives.sparkSession.read.parquet(path)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of a WARC file."""
    data = b"".join(members(content)) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        yield fields, data[start:stop]
        at = stop + 4


def warc_records(archives: DataFrame) -> DataFrame:
    """Per page record read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    The digest of a response is computed from the payload that was read; a mismatch with its header
    raises.
    """
    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = {n: [] for n in target.names}
                for fields, block in read_warc(content):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    digest, length = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                    if kind == "response":
                        payload = split_http(block)[2]
                        if base32_sha1(payload) != digest or len(payload) != length:
                            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    for n, v in zip(target.names, (int(page) if page else None, length, digest, kind,
                                                   int(refers) if refers else None)):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    target = to_arrow_schema(_parse_datatype_string(schema))
    return archives.select("content").mapInArrow(run, schema)


def export_files(archives: DataFrame, folder: str) -> int:
    """Write every archive as a file into ``folder`` (any URI that pyarrow's file systems know).

    A file appears under its name only when it is whole, so a task that runs again does no harm.
    Returns the number of files.
    """
    def run(batches):
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            names = batch.column("archive").to_pylist()
            for name, content in zip(names, batch.column("content").to_pylist()):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(content)
                system.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [len(names)]})

    return archives.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def pages_through_warc(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back."""
    spark = pages.sparkSession
    arc = write_arc(pages, stage_path(spark, "arc"))
    return warc_records(convert(arc, stage_path(spark, "warc"), min_revisit_bytes))
