"""Legacy archive converter: ARC records in, WARC records out, and the archives read back.

An ARC container starts with a ``filedesc`` record that names its version; a record is a header line (5 fields in version
1, 10 in version 2), as many bytes as the line declares, and a newline. The converter parses lines and lengths, then
makes for each record a WARC record of the same block: an identifier, the line's timestamp in ISO form, a type and SHA-256
digests of payload and block. An HTTP block is a response, any other (dns, ftp, …) a resource of the content type that the
line names. Of responses with equal payloads of at least ``SMALL`` bytes the one with the smallest id stays one; the others
are revisits that name it and carry the HTTP header only. A dedup index (digest -> smallest id) joined to the records
decides that. A container's filedesc becomes the name and version in the warcinfo record that each archive begins with.

Archives are gzip members, one a record, in the shared folder; a task writes each file under a temporary name and moves
it, and only files named by finished tasks are read.

Defined cases: a null html has an empty payload, and payloads are whole, however long; a null or blank url becomes
``urn:page:<id>``, white space in one is percent-encoded, and so is what an id holds beyond letters and digits; a null
page_id is kept as such and sorts after all others; rows that repeat the smallest id of a payload are all responses; an
empty table gives no archive and no rows. Only the named columns are read, so no other name can clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import new_path, utf8, written

SMALL = 100
ARC_BYTES = 4 << 20
FILE_BYTES = 64 << 20
#: Tasks that read archives back, at most; each takes several files then.
MAX_READERS = 4096
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ARC


def arc_start(name: str, version: int, date: str) -> bytes:
    block = f"{version} 0 corpusloom\n{FIELDS[version]}\n".encode()
    rest = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, name: str, offset: int, ip: str = "0.0.0.0", kind: str = "text/html") -> bytes:
    rest = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} {ip} {date} {kind}{rest} {len(block)}\n".encode() + block + b"\n"


def arc_records(raw: bytes) -> Iterator[dict]:
    """Records of one container, with its name and version. Fields are taken from the right: old URLs hold blanks."""
    at, version, name = 0, 0, ""
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        end = raw.index(b"\n", at)
        line = raw[at:end].decode("utf-8", "replace")
        length = int(line.rpartition(" ")[2])
        block, at = raw[end + 1 : end + 1 + length], end + 1 + length
        if len(block) < length:
            raise ValueError(f"record is cut off: {line[:200]}")
        if line.startswith("filedesc://"):
            version, name = int(block.split(b" ", 1)[0]), line.split(" ", 1)[0].removeprefix("filedesc://")
            continue
        names = FIELDS[version].split()
        yield dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True)) | {"block": block, "arc": f"{name} version {version}"}


def http_block(page: str | None, payload: bytes) -> bytes:
    named = "" if page is None else f"X-Page-Id: {quote(page, safe='')}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def header(block: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?i)^" + name + rb":[ \t]*([^\r\n]*)", block.partition(b"\r\n\r\n")[0], re.M)
    return m and m[1].decode()


def is_http(block: bytes) -> bool:
    return block.startswith(b"HTTP/")


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if is_http(block) else block


def page_url(url: str | None, page: str | None) -> str:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())
    return clean or f"urn:page:{quote(page, safe='') if page is not None else ''}"


def to_arc(pages: DataFrame, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ARC containers (name, content) of about ARC_BYTES, versions 1 and 2 by turns."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = version = buffer = None
        for batch in batches:
            for page, url, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if buffer is None:
                    name = f"{uuid.uuid4().hex}.arc"
                    version = 2 if version == 1 else 1
                    buffer = bytearray(arc_start(name, version, date))
                buffer += arc_record(version, page_url(url, page), date, http_block(page, payload or b""), name, len(buffer))
                if len(buffer) >= ARC_BYTES:
                    yield pa.record_batch([pa.array([name]), pa.array([bytes(buffer)], pa.binary())], ["name", "content"])
                    buffer = None
        if buffer is not None:
            yield pa.record_batch([pa.array([name]), pa.array([bytes(buffer)], pa.binary())], ["name", "content"])

    rows = pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), utf8(F.col(html_col)))
    return rows.toDF("page", "url", "payload").mapInArrow(pack, "name string, content binary")


_RECORD = "page string, url string, ip string, date string, kind string, arc string, block binary, digest string"


def parse_arc(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """ARC containers (as the binaryFile source reads them) as records: page, url, ip, date, kind (the content type), arc
    (the container), block, digest of the payload."""
    names = [part.split()[0] for part in _RECORD.split(", ")]
    kinds = [pa.binary() if n == "block" else pa.string() for n in names]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.columns[0].to_pylist():
                rows = []
                for r in arc_records(raw):
                    page = header(r["block"], b"X-Page-Id") if is_http(r["block"]) else None
                    digest = hashlib.sha256(payload_of(r["block"])).hexdigest()
                    rows.append((None if page is None else unquote(page), r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], r["arc"], r["block"], digest))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return arcs.select(content_col).mapInArrow(parse, _RECORD)


# --- WARC


def record_id(page: str | None, *parts: str) -> str:
    """The identifier of a page's record; of one without an id, made from url, date and digest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>" if page is None else f"<urn:corpus-page:{quote(page, safe='')}>"


def page_of(identifier: str) -> str | None:
    return unquote(identifier[17:-1]) if identifier.startswith("<urn:corpus-page:") else None


def iso_date(date: str) -> str:
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _lines(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *[f"{k}: {v}" for k, v in fields]]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo_record(name: str, date: str, arc: str) -> tuple[str, bytes]:
    """(identifier, record) that an archive begins with."""
    identifier = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    block = f"software: corpusloom\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC, the first container being {arc}\r\n".encode()
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", identifier), ("WARC-Date", iso_date(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return identifier, _lines(fields, block)


def warc_record(page: str | None, url: str, date: str, block: bytes, digest: str, refers_to: str | None, ip: str = "0.0.0.0", kind: str = "text/html", info: str | None = None) -> bytes:
    http = is_http(block)
    kept = block if refers_to is None else block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    fields = [
        ("WARC-Type", "resource" if not http else "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, url, date, digest)),
        ("WARC-Date", iso_date(date)),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response" if http else kind),
    ]
    fields += [("WARC-IP-Address", ip)] if ip not in ("", "0.0.0.0") else []
    fields += [("WARC-Warcinfo-ID", info)] if info else []
    fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE), ("WARC-Truncated", "length")] if refers_to is not None else []
    return _lines(fields, kept)


def gzip_members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The contents of each member; one at a time is in memory."""
    member, parts = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            parts.append(member.decompress(chunk))
            chunk = member.unused_data
            if member.eof:
                yield b"".join(parts)
                member, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive is cut off")


def read_record(raw: bytes) -> tuple[str | None, int, str, str, str | None] | None:
    """(page, payload bytes, payload digest, type, page referred to), with lengths and digests checked; None of a warcinfo."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("declared length doesn't hold")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("block digest doesn't hold")
    if fields["WARC-Type"] == "warcinfo":
        return None
    page, digest = page_of(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"][7:]
    if fields["WARC-Type"] == "revisit":
        return page, int(header(block, b"Content-Length")), digest, "revisit", page_of(fields["WARC-Refers-To"])
    payload = block if fields["WARC-Type"] == "resource" else payload_of(block)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload digest doesn't hold")
    return page, len(payload), digest, fields["WARC-Type"], None


def dedup_index(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", small: int = SMALL) -> DataFrame:
    """digest -> first (smallest id): payloads of at least `small` bytes that more than one row has."""
    raw = F.coalesce(utf8(F.col(html_col)), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).alias("n")).filter(F.col("n") >= small)
    groups = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return groups.filter("n > 1").select("digest", F.col("first").cast("string").alias("first"))


def write_warc(records: DataFrame, index: DataFrame, path: str, file_bytes: int = FILE_BYTES, level: int = 3) -> DataFrame:
    """Writes the archives under `path` and returns the table of their paths."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder)
        sink = done = info = None
        size = 0

        def put(record: bytes) -> int:
            member = zlib.compressobj(level, zlib.DEFLATED, 31)
            return sink.write(member.compress(record) + member.flush())

        for batch in batches:
            for page, url, ip, date, kind, arc, block, digest, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    done = f"{folder}/{name}"
                    sink, size = fs.open_output_stream(f"{done}.tmp", compression=None), 0
                    info, record = warcinfo_record(name, date, arc)
                    size += put(record)
                refers_to = None if first is None or first == page or not is_http(block) else first
                size += put(warc_record(page, url, date, block, digest, refers_to, ip, kind, info))
                if size >= file_bytes:
                    sink.close()
                    fs.move(f"{done}.tmp", done)
                    yield pa.record_batch([pa.array([done])], ["file"])
                    sink = None
        if sink is not None:
            sink.close()
            fs.move(f"{done}.tmp", done)
            yield pa.record_batch([pa.array([done])], ["file"])

    joined = records.join(index, "digest", "left").select("page", "url", "ip", "date", "kind", "arc", "block", "digest", "first")
    return written(joined.mapInArrow(write, "file string"), "warc-files")


def read_warc(files: DataFrame, path: str) -> DataFrame:
    """The records of the archives: page, payload_bytes, payload_digest, record_type, refers_to (as texts)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        make = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for file in batch.columns[0].to_pylist():
                rows = []
                with fs.open_input_stream(file, compression=None) as source:
                    for raw in gzip_members(iter(lambda s=source: s.read(1 << 20), b"")):
                        if (row := read_record(raw)) is not None:
                            rows.append(row)
                        if len(rows) == 4096:
                            yield make(rows)
                            rows = []
                if rows:
                    yield make(rows)

    spread = files.repartition(max(1, min(files.count(), MAX_READERS)))
    return spread.mapInArrow(read, "page string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def convert(pages: DataFrame, path: str | None = None, id_col: str = "page_id", html_col: str = "html", **options) -> DataFrame:
    """pages -> ARC containers -> WARC archives under `path` -> their records, read back; ids have the type of pages'."""
    path = path or new_path(pages.sparkSession, "warc")
    kind = pages.schema[id_col].dataType
    records = parse_arc(to_arc(pages, id_col=id_col, html_col=html_col, **options))
    files = write_warc(records, dedup_index(pages, id_col, html_col), path)
    back = read_warc(files, path)
    return back.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
