"""Legacy ARC archives to WARC.

Pages are written as ARC files, version 1 or 2 by turns, as a crawler of old would leave them. The converter parses the
version block, each record's header line by the field list that the version declares, and its declared length, and
writes an equivalent WARC/1.0 record: an identifier derived from the record itself, the 14-digit timestamp as W3C date,
type response or revisit, block and payload digests. Reading the WARC files back gives the results.

Payloads never pass through a shuffle: each archive is a file in shared storage, and only a small index (page, file,
digest, length) is exchanged to elect the response among records of equal payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import shared_uri, stored, table

#: Bytes of payload from which an equal one becomes a revisit.
REVISIT_BYTES = 1000
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: The field lists of the two versions' record header lines.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PAGE_HEADER = "X-Page-Id"
#: The time of the version blocks, and the seconds after it over which the records' times are spread.
STAMP = "19961020000000"
SPREAD_S = 10 * 365 * 86400
LEVEL = 1


def _open(path: str, write: bool = False):
    """A file of any store that pyarrow knows, by its URI."""
    fs, inner = pafs.FileSystem.from_uri(path)
    if write:
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(inner, compression=None)
    return fs.open_input_stream(inner, compression=None)


def _member(data: bytes) -> bytes:
    """One gzip member, with no time stamp, so that a task run again writes the same file."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(url: str | None) -> str:
    """A URL as header fields allow it: no white space; "-" for none."""
    return re.sub(r"[\x00-\x20\x7f]+", "%20", url or "").strip() or "-"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 weftline\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {STAMP} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ")
    return line.encode() + f"{len(body)}\n".encode() + body + b"\n"


def stamp(url: str | None, page_id: str) -> str:
    """The 14 digits of a record's time, made from what it is about."""
    seconds = int.from_bytes(hashlib.sha1(f"{page_id} {url}".encode()).digest()[:6]) % SPREAD_S
    return (datetime.strptime(STAMP, "%Y%m%d%H%M%S") + timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def arc_record(version: int, url: str | None, page_id: str, payload: bytes, name: str, offset: int) -> bytes:
    """A record whose body is an HTTP response; the page's id is one of its headers."""
    body = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: {page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    line = f"{_clean(url)} 0.0.0.0 {stamp(url, page_id)} text/html "
    if version == 2:
        line += f"200 {hashlib.md5(payload).hexdigest()} - {offset} {name} "
    return line.encode() + f"{len(body)}\n".encode() + body + b"\n"


class Faulty(ValueError):
    """What can't be read as a record; the next ones may."""


def _version_block(line: bytes, body: bytes) -> list[str]:
    """The fields that a version block declares, of a version that has them."""
    lines = body.split(b"\n")
    version, fields = lines[0].split()[:1], lines[1].decode("utf-8", "replace").split() if len(lines) > 1 else []
    if not version or not version[0].isdigit() or " ".join(fields) != FIELDS.get(int(version[0])):
        raise Faulty(f"version block declares {version} with the fields {fields}")
    return fields


def _header(line: bytes, fields: list[str]) -> dict[str, str]:
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
    if len(parts) != len(fields) or not (parts[-1].isascii() and parts[-1].isdigit()):
        raise Faulty(f"no ARC header line: {line[:100]!r}")
    return dict(zip(fields, parts, strict=True))


def read_arc(stream: Any) -> Iterator[tuple[dict[str, str], bytes] | Faulty]:
    """(fields, body) of each record of an ARC file, or what is wrong with it; the version block, told apart by filedesc://, is none.

    The version block's second line names the fields, its first the version; a header line is split from the right, as
    only the URL could hold blanks. Bodies are taken by their declared length, whatever they contain. After a line that
    is no header, which costs one Faulty however many follow it, reading goes on at the next line that is one.
    """
    fields, lost = FIELDS[1].split(), False
    while line := stream.readline():
        if not line.strip():
            continue
        try:
            first = line.startswith(b"filedesc://")
            header = {"Archive-length": line.split()[-1].decode("ascii", "replace")} if first else _header(line, fields)
            if not header["Archive-length"].isdigit():
                raise Faulty(f"no ARC header line: {line[:100]!r}")
            body = stream.read(n := int(header["Archive-length"]))
            if len(body) != n:
                raise Faulty(f"{line[:100]!r}: {len(body)} of {n} declared bytes")
            lost = False
            if first:
                fields = _version_block(line, body)
            else:
                yield header, body
        except Faulty as e:
            if not lost:
                yield e
            lost = True


def _identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def record_id(file: str, place: int) -> str:
    """The identifier of the record at a place, counted from 0, of an ARC file: alike whenever that file is converted, and no other record's."""
    return _identifier("record", file.rpartition("/")[2], str(place))


def warc_date(digits: str) -> str:
    """An ARC date of 14 digits, or of fewer from the year on, as WARC writes it; what isn't a date is the time of STAMP."""
    try:
        if not 4 <= len(digits) <= 14 or not (digits.isascii() and digits.isdigit()):
            raise ValueError(digits)
        return datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return warc_date(STAMP)


def warc_record(fields: dict[str, str], body: bytes, own_id: str, refers_to: tuple[str, str] | None) -> bytes:
    """The WARC record of an ARC record; refers_to: page and record id of the response with the same payload, for a revisit (whose block keeps the HTTP header alone)."""
    head, _, payload = body.partition(b"\r\n\r\n")
    digest = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    block = body if refers_to is None else head + b"\r\n\r\n"
    lines = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own_id}",
        f"WARC-Date: {warc_date(fields['Archive-date'])}", f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[1]}", f"X-Refers-To-Page: {refers_to[0]}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_warc(stream: Any) -> Iterator[tuple[dict[str, str], bytes] | Faulty]:
    """(fields, block) of each record, or what is wrong with it; after a fault reading goes on at the next line that begins a record."""
    lost = False
    while line := stream.readline():
        if not line.strip() or lost and not line.startswith(b"WARC/"):
            continue
        if not line.startswith(b"WARC/"):
            yield Faulty(f"no WARC record: {line[:100]!r}")
            lost = True
            continue
        fields, lost = {}, False
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name] = value.strip()
        length = fields.get("Content-Length", "")
        block = stream.read(int(length)) if length.isdigit() else b""
        if not length.isdigit() or len(block) != int(length):
            yield Faulty(f"{fields.get('WARC-Record-ID')}: {len(block)} of {length or 'no'} declared bytes")
            lost = True
            continue
        yield fields, block


def _page_of(head: bytes) -> Any:
    """The page id among a record's HTTP headers."""
    if not (m := re.search(rf"\r\n{PAGE_HEADER}: ([^\r]*)".encode(), head)):
        raise Faulty("a record names no page")
    return json.loads(m[1])


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """pages (page_id, url, html) -> an index row for each record: file, place in it, page_id, digest, payload_bytes. A file is named by its task's attempt, so a task that runs again never writes over one that the index names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt, n, size, place, out = task.partitionId(), task.taskAttemptId(), 0, 0, 0, None
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload, version = (html or "").encode(), 1 + (part + n) % 2
                if out is None:
                    name = f"part-{part:06d}-{attempt}-{n:04d}.arc.gz"
                    path = f"{folder}/{name}"
                    out = _open(path, write=True)
                    out.write(_member(arc_version_block(version, name)))
                    size = place = 0
                out.write(_member(arc_record(version, url, json.dumps(page_id), payload, name, out.tell())))
                rows.append((path, place, page_id, hashlib.sha1(payload).hexdigest(), len(payload)))
                place += 1
                if (size := size + len(payload)) > ARCHIVE_BYTES:
                    out.close()
                    out, n = None, n + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 2 else pa.array(c, batch.column(0).type) for i, c in enumerate(zip(*rows, strict=True))], ["file", "place", "page_id", "digest", "payload_bytes"])
        if out is not None:
            out.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"file string, place long, page_id {kind}, digest string, payload_bytes long")


def elect(index: DataFrame) -> DataFrame:
    """(file, place, refers_to, refers_file, refers_place) of each record: of those with equal payloads of REVISIT_BYTES or more, the one with the largest page id is referred to by all others. Rows of that same id, should it repeat, are all responses; null ids come last."""
    told = F.struct("page_id", "file", "place")
    best = index.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max(told).alias("best"))
    best = best.select("digest", "best.page_id", "best.file", "best.place").toDF("digest", "best", "best_file", "best_place")
    joined = index.join(best, "digest", "left")
    other = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    mark = lambda c: F.when(other, F.col(c))
    return joined.select("file", "place", mark("best").alias("refers_to"), mark("best_file").alias("refers_file"), mark("best_place").alias("refers_place"))


def convert(index: DataFrame, folder: str) -> DataFrame:
    """index (file, place, refers_to, refers_file, refers_place): writes a WARC file for each ARC file; returns (file, records, faults). A task holds the index rows of one archive, which ARCHIVE_BYTES and the least record bound; records pass one by one. What can't be read as a record is counted in faults, the first hundred with their reason, and left out."""

    def run(key: Any, group: Any) -> Any:
        import pandas as pd

        from pyspark import TaskContext

        path, refers = key[0], {}
        for place, page, file, at in zip(group["place"], group["refers_to"], group["refers_file"], group["refers_place"], strict=True):
            if not pd.isna(at):
                refers[int(place)] = json.dumps(page if isinstance(page, str) else int(page)), record_id(file, int(at))
        name = path.rpartition("/")[2].replace(".arc.gz", f"-{TaskContext.get().taskAttemptId()}.warc.gz")
        n, faults = 0, []
        with _open(path) as raw, _open(out := f"{folder}/{name}", write=True) as to:
            info = f"software: weftline\r\nformat: WARC File Format 1.0\r\nconverted-from: {path.rpartition('/')[2]}\r\n".encode()
            head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_identifier('info', name)}\r\nWARC-Date: {warc_date(STAMP)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            to.write(_member(head.encode() + info + b"\r\n\r\n"))
            for record in read_arc(io.BufferedReader(gzip.GzipFile(fileobj=raw))):
                if isinstance(record, Faulty):
                    faults.append(str(record))
                    continue
                to.write(_member(warc_record(*record, record_id(path, n), refers.get(n))))
                n += 1
        return pd.DataFrame({"file": [out], "records": [n], "faults": [faults[:100]]})

    return index.groupBy("file").applyInPandas(run, "file string, records long, faults array<string>")


def read_back(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of WARC files (file): page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's payload is its response's: length and digest come from its HTTP header and WARC-Payload-Digest; a response's are computed anew, and one that differs from its header is an error. What can't be read as a record is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with _open(path) as raw:
                    for record in read_warc(io.BufferedReader(gzip.GzipFile(fileobj=raw))):
                        if isinstance(record, Faulty) or record[0]["WARC-Type"] == "warcinfo":
                            continue
                        fields, block = record
                        head, _, payload = block.partition(b"\r\n\r\n")
                        page = _page_of(head)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                        if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
                            raise ValueError(f"{path}: the payload of {page} doesn't match its digest")
                        refers = fields.get("X-Refers-To-Page")
                        rows.append((page, size, digest.hex(), fields["WARC-Type"], None if refers is None else json.loads(refers)))
                        if len(rows) >= 10_000:
                            yield as_batch(rows)
                            rows = []
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        ids = pa.string() if id_type == "string" else pa.int64() if id_type == "bigint" else pa.int32()
        kinds = (ids, pa.int64(), pa.string(), pa.string(), ids)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(run, f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}")


def archive(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) through ARC and WARC files and back; see read_back for the columns.

    A null html is an empty payload; a null url is written as "-". Payloads below REVISIT_BYTES are always responses.
    Rows that repeat a page_id each give a record; if theirs is the largest id of an equal payload, all are responses.
    No size is special: payloads are read by declared length. An empty table gives no rows. The archives stay in the
    shared folder.
    """
    folder = shared_uri(pages.sparkSession, "archives")
    index = stored(write_arcs(pages, f"{folder}/arc"), "arc-index")
    files = stored(convert(elect(index), f"{folder}/warc"), "warc-files")
    spread = files.select("file").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "file")
    return read_back(spread, pages.schema["page_id"].dataType.simpleString())


def op4_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


OP4_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
b as (select payload_digest, max(page_id) as best from p where payload_bytes >= 1000 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when best is not null and best <> p.page_id then 'revisit' else 'response' end as record_type,
  case when best <> p.page_id then best end as refers_to
from p left join b on p.payload_digest = b.payload_digest and p.payload_bytes >= 1000
"""
