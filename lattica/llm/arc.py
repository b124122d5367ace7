"""Conversion of ARC archives, versions 1 and 2, to WARC records.

An ARC record is a header line, as many bytes as its last field declares, and a line feed.  The first record of an
archive (``filedesc:``) holds the version number and the names of the fields of the header lines after it.  The
converter checks declared lengths against what follows, finds its place again after a damaged record, and makes
the WARC fields that ARC doesn't have: record ids (name-based, so a rerun gives the same), types, dates and digests.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import ipaddress
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "archive string, offset bigint, arc_version int, warc_type string, record_id string, warc_date string, target_uri string, content_type string, content_length bigint, block_digest string, payload_digest string, problem string, record binary"
FIELDS = {
    1: ("url", "ip-address", "archive-date", "content-type", "archive-length"),
    2: ("url", "ip-address", "archive-date", "content-type", "result-code", "checksum", "location", "offset", "filename", "archive-length"),
}
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
_HEADER = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*:[^\n]* \d{8,17}(?: [^\n ]+){1,8} \d+\r?\n")
_NEXT = re.compile(rb"\r?\n+(?=[A-Za-z][A-Za-z0-9+.-]*:[^\n]* \d{8,17}(?: [^\n ]+){1,8} \d+\r?\n)")
_END = re.compile(rb"\r?\n\r?\n")


@dataclass
class ArcRecord:
    offset: int
    version: int
    fields: dict[str, str]
    block: bytes
    problem: str | None = None


def unpacked(content: bytes) -> tuple[bytes, str | None]:
    """The archive without its gzip members, of which each record may have one; what is wrong with them, if anything.

    Of a damaged member what can be read is kept; the next member is sought behind it.
    """
    if content[:2] != b"\x1f\x8b":
        return content, None
    parts, at, problem, view = [], 0, None, memoryview(content)
    while at < len(content):
        member, start = zlib.decompressobj(31), at
        try:
            while at < len(content) and not member.eof:
                parts.append(member.decompress(view[at : at + 65536]))
                at += 65536
        except zlib.error:
            problem = problem or "damaged gzip member"
        else:
            if member.eof:
                at = min(at, len(content)) - len(member.unused_data)
                while at < len(content) and content[at] == 0:
                    at += 1
                if at == len(content) or content[at : at + 2] == b"\x1f\x8b":
                    continue
                problem = problem or "damaged gzip member"
            else:
                problem = problem or "cut gzip member"
        found = content.find(b"\x1f\x8b\x08", start + 1 if not member.eof else at)
        if found < 0:
            break
        parts.append(b"\n")  # a record that was cut must not run into the next
        at = found
    return b"".join(parts), problem


def parse_header(line: bytes, names: tuple[str, ...]) -> dict[str, str] | None:
    """A header line's fields; None if it isn't one.  A URL may hold spaces, so fields are taken from the right."""
    values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
    if len(values) != len(names):
        return None
    fields = dict(zip(names, values, strict=True))
    if not fields["archive-length"].isdecimal() or not fields["archive-length"].isascii() or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", fields["url"]):
        return None
    return fields


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an unpacked archive; damaged ones come with a ``problem`` and what could be read of them."""
    at, version, names = 0, 1, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end + 1] if end >= 0 else data[at:]
        fields = parse_header(line, names)
        other = 3 - version
        if (fields is None or not _date(fields["archive-date"])) and line.startswith(b"filedesc:"):
            fields = parse_header(line, FIELDS[other]) or fields
        if fields is None or not line.endswith(b"\n"):
            found = _NEXT.search(data, at)
            stop = found.end() if found else len(data)
            yield ArcRecord(at, version, {}, data[at:stop].rstrip(b"\r\n"), "no header line")
            at = stop
            continue
        start, length = end + 1, int(fields["archive-length"])
        stop = start + length
        problem = None
        if stop > len(data):
            problem = "shorter than declared"
        elif stop < len(data) and data[stop : stop + 1] not in (b"\n", b"\r"):
            problem = "longer than declared"
        if problem:
            found = _NEXT.search(data, start)
            stop = found.start() if found else len(data)
            if not found:
                stop = start + len(data[start:stop].rstrip(b"\r\n")) if problem.startswith("longer") else stop
        block = data[start:stop]
        if line.startswith(b"filedesc:"):
            first = block.split(b"\n", 2)
            told = first[0].split()
            if told and told[0] in (b"1", b"2"):
                version = int(told[0])
                names = FIELDS[version]
            else:
                problem = problem or "unknown version"
            if len(first) > 1 and first[1].strip():
                given = tuple(x.lower() for x in first[1].decode("ascii", "replace").split())
                if given[-1:] == ("archive-length",) and {"url", "archive-date"} <= set(given):
                    names = given
        yield ArcRecord(at, version, fields, block, problem)
        at = stop


def _date(value: str) -> str | None:
    """An ARC date of 8 to 17 digits as a WARC date; None if it is none."""
    digits = value[:14].ljust(14, "0")
    if not re.fullmatch(r"[0-9]{14}", digits) or not 8 <= len(value):
        return None
    year, month, day, hour, minute, second = digits[:4], digits[4:6], digits[6:8], digits[8:10], digits[10:12], digits[12:]
    try:
        datetime.date(int(year), int(month), int(day))
    except ValueError:
        return None
    if hour >= "24" or minute >= "60" or second > "60":
        return None
    return f"{year}-{month}-{day}T{hour}:{minute}:{second}Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_warc(archive: str, record: ArcRecord) -> dict:
    """The WARC record for an ARC record: its fields, and ``record``, all of its bytes.

    An archive's description becomes ``warcinfo``; a block that begins with an HTTP status line, or a DNS answer,
    becomes ``response``; everything else with a header ``resource``; bytes without a header ``metadata``.
    """
    url, block, problem = record.fields.get("url"), record.block, record.problem
    date = _date(record.fields.get("archive-date", ""))
    declared = record.fields.get("content-type") or "application/octet-stream"
    payload = None
    if url is None:
        kind, content_type = "metadata", "application/octet-stream"
    elif url.startswith("filedesc:"):
        kind, content_type = "warcinfo", declared
    elif re.match(rb"HTTP/\d", block):
        kind, content_type = "response", "application/http; msgtype=response"
        head = _END.search(block)
        payload = block[head.end() :] if head else b""
    elif url.startswith("dns:"):
        kind, content_type, payload = "response", "text/dns", block
    else:
        kind, content_type, payload = "resource", declared, block
    if date is None:
        date, problem = "1970-01-01T00:00:00Z", problem or "no date"
    content_type = re.sub(r"[\r\n]+", " ", content_type)
    name = f"{archive}#{record.offset}"
    found = {
        "archive": archive, "offset": record.offset, "arc_version": record.version, "warc_type": kind, "record_id": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>", "warc_date": date,
        "target_uri": url if kind in ("response", "resource") else None, "content_type": content_type, "content_length": len(block), "block_digest": digest(block), "payload_digest": None if payload is None else digest(payload), "problem": problem,
    }
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {found['record_id']}", f"WARC-Date: {date}"]
    if found["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {url}")
    address = record.fields.get("ip-address", "")
    if kind == "response" and _is_address(address):
        lines.append(f"WARC-IP-Address: {address}")
    if kind == "warcinfo":
        lines.append("WARC-Filename: " + re.sub(r"[\r\n]+", " ", archive))
    lines += [f"WARC-Block-Digest: {found['block_digest']}"] + ([f"WARC-Payload-Digest: {found['payload_digest']}"] if payload is not None else [])
    if problem:
        lines.append("WARC-Truncated: unspecified")
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    found["record"] = "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return found


_ADDRESSES: dict[str, bool] = {}


def _is_address(value: str) -> bool:
    if value not in _ADDRESSES:
        try:
            good = not ipaddress.ip_address(value).is_unspecified
        except ValueError:
            good = False
        if len(_ADDRESSES) > 100_000:
            _ADDRESSES.clear()
        _ADDRESSES[value] = good
    return _ADDRESSES[value]


def convert_arcs(archives: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One WARC record for each record of each ARC archive (as ``spark.read.format("binaryFile")`` gives them).

    Returns ``archive, offset`` (in the unpacked archive), the WARC fields, ``problem`` (null if none) and
    ``record``, the WARC record's bytes; those of an archive, one after another, are a WARC file.  A null or empty
    archive gives no rows, a null path counts as the empty string, a repeated row gives its records again.  Two
    captures of one URL are two records.  Other columns are not read; an empty table gives no rows.
    """
    kinds = [(p.split()[0], p.split()[1]) for p in SCHEMA.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, types[t]) for n, t in kinds])

    def convert(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not content:
                    continue
                data, damage = unpacked(content)
                held, size = [], 0
                for record in parse_arc(data):
                    held.append(to_warc(path or "", record))
                    size += len(record.block)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if damage:
                    held.append(to_warc(path or "", ArcRecord(len(data), 1, {}, b"", damage)))
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content")).mapInArrow(convert, SCHEMA)


def arc_bytes(name: str, rows, version: int = 1) -> bytes:
    """An ARC archive of (url, address, date, content type, block) rows."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    about = f"{version} 0 archive\n{names}\n".encode()
    middle = "200 - - 0 - " if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {middle}{len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for url, address, date, kind, block in rows:
        middle = f"200 {hashlib.md5(block).hexdigest()} - {at} {name} " if version == 2 else ""
        head = f"{url} {address} {date} {kind} {middle}{len(block)}\n".encode()
        out += [head, block, b"\n"]
        at += len(head) + len(block) + 1
    return b"".join(out)


def archives_of_pages(pages: DataFrame, size: int = 4_000_000) -> DataFrame:
    """Web pages as ARC archives of about ``size`` bytes, half of them version 1 and half version 2: ``path, content``.

    Pages are dealt by hash to archives, in the order of their ids, so the same pages give the same archives however
    they are partitioned.  Pages without a URL or HTML can't be archived.
    """
    rows = pages.where("url IS NOT NULL AND html IS NOT NULL").select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace("url", r"[\r\n]", "").alias("url"), "html")
    total = rows.agg(F.sum(F.octet_length("html") + F.octet_length("url"))).first()[0] or 0
    archives = 2 * max(1, math.ceil(total / (2 * size)))

    def archive(table: pa.Table) -> pa.Table:
        table = table.sort_by([("page_id", "ascending"), ("url", "ascending"), ("html", "ascending")])
        held, number = [], table.column("archive")[0].as_py()
        for page, url, html in zip(*(table.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            body = html.encode()
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
            n = (page or 0) % 2**31
            held.append((url, f"192.0.2.{n % 254 + 1}", f"2001{n // 86400 % 12 + 1:02}{n // 86400 % 28 + 1:02}{n // 3600 % 24:02}{n // 60 % 60:02}{n % 60:02}", "text/html", block))
        name = f"pages-{number:06d}-of-{archives:06d}.arc"
        return pa.table({"path": [name], "content": pa.array([arc_bytes(name, held, 1 + number % 2)], pa.binary())})

    dealt = rows.withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(archives)))
    return dealt.groupBy("archive").applyInArrow(archive, "path string, content binary")
