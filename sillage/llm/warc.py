"""WARC archives: writing, normalising monolithic gzip streams, and indexed reading.

Archives are often handed over as one gzip stream over the whole file, which can't be
read from the middle.  The normaliser inflates such a stream once, record by record,
writes every record as a gzip member of its own, and keeps a sidecar index of the
members' offsets; the reader then opens any record by its offset.  Memory is bounded by
a few buffers, except where a caller asks for whole payloads.

Files go through ``pyarrow.fs``, so folders may be any URI that it knows.  Every file
is written under a temporary name and moved when it is complete.  An archive's name is
its attempt's own, so attempts that run side by side can't meet; the table of paths
names the files that count, and whatever else a lost attempt left belongs to nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.arrow import map_rows, tidy
from sillage.llm.scratch import Scratch, small

_BUFFER = 1 << 20
_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(key: int | None) -> str:
    """The record id of a key; a null key has one of its own kind."""
    return f"<urn:sillage:record:{'null' if key is None else key}>"


def _key(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:sillage:record:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


#: Escapes in a header value: control characters, and a percent sign that an escape could be read from.
_ESCAPED = r"%(0[0-9A-F]|1[0-9A-F]|7F|25)"


def _line(value: str) -> str:
    """A header value: control characters can't stand in a header and are percent-encoded; ``_unline`` undoes it exactly."""
    return re.sub(rf"[\x00-\x1f\x7f]|%(?={_ESCAPED[2:-1]})", lambda m: f"%{ord(m[0]):02X}", value)


def _unline(value: str | None) -> str | None:
    return None if value is None else re.sub(_ESCAPED, lambda m: chr(int(m[1], 16)), value)


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[bytes, bytes]:
    """Head and block of a record; a revisit's block ends after the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END, block


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Target:
    """A file that appears under its name when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        try:
            self.fs.move(self.part, self.path)  # replaces a file of an earlier attempt where the system can
        except OSError:
            self.fs.delete_file(self.path)
            self.fs.move(self.part, self.path)


def write_archives(rows: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", level: int = 4, roll: int = 1 << 30) -> DataFrame:
    """Write (key, url, payload, digest, refers_to) rows as monolithic gzip WARC files; ``digest`` is SHA-1 in hex.

    One row (path, records) for each file; a partition starts a new file after ``roll``
    bytes of records.  Names differ with every evaluation, so the result is to be
    written, as ``archive`` does, and not evaluated again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, target, records, size = TaskContext.get().partitionId(), 0, None, 0, 0

        def close() -> pa.RecordBatch:
            target.write(squeeze.flush())
            target.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if target is None:
                    path = f"{folder}/part-{part:05d}-{count:03d}-{uuid.uuid4().hex[:12]}.warc.gz"
                    target, squeeze, records, size = _Target(path), zlib.compressobj(level, wbits=31), 0, 0
                for piece in record(key, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, date):
                    target.write(squeeze.compress(piece))
                    size += len(piece)
                target.write(squeeze.compress(_END))
                records += 1
                if size >= roll:
                    yield close()
                    target, count = None, count + 1
        if target is not None:
            yield close()

    return rows.select("key", "url", "payload", "digest", "refers_to").mapInArrow(tidy(run), "path string, records long")


class _Inflated:
    """The bytes of a gzip file, however many members it has, with bounded read-ahead."""

    def __init__(self, file):
        self.file, self.inflate, self.held, self.done = file, zlib.decompressobj(31), b"", False

    def more(self) -> bool:
        while not self.done:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                if not rest and not (rest := self.file.read(_BUFFER)):
                    self.done = True
                    break
                self.inflate = zlib.decompressobj(31)
            else:
                rest = self.inflate.unconsumed_tail or self.file.read(_BUFFER)
                if not rest:
                    raise EOFError("the gzip stream ends early")
            data = self.inflate.decompress(rest, _BUFFER)
            if data:
                self.held += data
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                if self.held.strip():
                    raise EOFError("a record's head is cut off")
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.more():
                raise EOFError("a record's block is cut off")
            out, self.held = self.held[:size], self.held[size:]
            size -= len(out)
            yield out


def headers(head: bytes) -> dict[str, str]:
    """Header fields of a record's head, by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {n.strip().lower(): v for n, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}
    # a URL's own blanks stay, but for the one that belongs to the header
    return {n: v.removeprefix(" ") if n == "warc-target-uri" else v.strip() for n, v in fields.items()}


def normalise_file(source: str, target: str, level: int = 4) -> int:
    """Rewrite one gzip WARC with a member for each record, and its offsets to ``target`` + .idx; the number of records."""
    fs, path = _open(source)
    out, index, count = _Target(target), _Target(f"{target}.idx"), 0
    with fs.open_input_stream(path, compression=None) as file:
        stream = _Inflated(file)
        while (head := stream.until(_END)) is not None:
            fields = headers(head)
            start, squeeze = out.size, zlib.compressobj(level, wbits=31)
            out.write(squeeze.compress(head))
            for piece in stream.take(int(fields["content-length"])):
                out.write(squeeze.compress(piece))
            for piece in stream.take(len(_END)):
                out.write(squeeze.compress(piece))
            out.write(squeeze.flush())
            line = {"offset": start, "length": out.size - start, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri")}
            index.write((json.dumps(line) + "\n").encode())
            count += 1
    out.close()
    index.close()
    return count


def normalise(files: DataFrame, folder: str, *, level: int = 4) -> DataFrame:
    """Normalise the archives at ``files.path`` into ``folder``: path, index_path and records of each."""

    def row(path: str) -> tuple:
        target = f"{folder}/{path.rpartition('/')[2]}"
        return target, f"{target}.idx", normalise_file(path, target, level)

    run = map_rows(["path", "index_path", "records"], [pa.string(), pa.string(), pa.int64()], row)
    return files.select("path").mapInArrow(tidy(run), "path string, index_path string, records long")


def read_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of one record's member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(_END)
    fields = headers(head + _END)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_END)
    return fields, http, payload


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _entries(index_path: str) -> Iterator[dict]:
    fs, path = _open(index_path)
    with fs.open_input_stream(path, compression=None) as file:
        held = b""
        while data := file.read(_BUFFER):
            *lines, held = (held + data).split(b"\n")
            yield from map(json.loads, lines)


def read_archives(files: DataFrame, *, payload: bool = False) -> DataFrame:
    """Every record of normalised archives, opened by its indexed offset.

    key, url (as it was written, control characters and blanks included), record_type,
    refers_to, payload_bytes, payload_digest, and with ``payload`` the bytes (null for a
    revisit).  A response's length and digest are
    worked out from its payload and must equal its headers; a revisit's are those of
    its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = _open(path)
                with fs.open_input_file(at) as file:

                    def row(entry: dict) -> tuple:
                        file.seek(entry["offset"])
                        fields, http, body = read_record(file.read(entry["length"]))
                        size, digest = int(headers(http + _END)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                        kind = fields["warc-type"]
                        if kind == "response" and (size, digest) != (len(body), payload_digest(body)):
                            raise ValueError(f"{path}: payload of {fields['warc-record-id']} differs from its headers")
                        out = (_key(fields["warc-record-id"]), _unline(fields.get("warc-target-uri")), kind, _key(fields.get("warc-refers-to")), size, digest)
                        return (*out, body if kind == "response" else None) if payload else out

                    yield from _batches(map(row, _entries(index_path)), names, types)

    names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: 7 if payload else 6]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: len(names)]
    schema = "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    return files.select("path", "index_path").mapInArrow(tidy(run), schema)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    make: Callable = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for row in rows:
        held.append(row)
        size += len(row[6] or b"") if len(row) > 6 else 0
        if len(held) >= 2000 or size >= 8_000_000:
            yield make()
            held, size = [], 0
    if held:
        yield make()


#: Distinct payloads with copies, up to which their holders are broadcast (about 20 MB).
BROADCAST_HOLDERS = 200_000


def with_holders(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(key, url, payload, digest, refers_to) of every page, for ``write_archives``.

    Of the pages with equal payloads of at least ``least`` bytes that with the largest
    key holds the payload (rows that repeat this key too); the others refer to it.
    Null html is an empty payload; a null key never holds one that another key has.
    """
    scratch = Scratch(pages.sparkSession, "warc-holders")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= least)
    holders = scratch.save(large.groupBy("sha").agg(F.max("key").alias("holder"), F.count("*").alias("n")).filter("n > 1 and holder is not null").select("sha", "holder"))
    joined = rows.join(small(holders, BROADCAST_HOLDERS), "sha", "left")
    refers = F.when((F.octet_length("payload") >= least) & ~F.col("key").eqNullSafe(F.col("holder")), F.col("holder"))
    return joined.select("key", "url", "payload", F.col("sha").alias("digest"), refers.alias("refers_to"))


def archive(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, level: int = 4) -> DataFrame:
    """Write pages as WARC archives and normalise them: path, index_path and records of each file.

    Monolithic streams go to ``folder``/whole, members and indexes to ``folder``/records.
    Each archive is written, normalised and counted by one task.  All of it happens
    here and once: the result is a written table.  An empty table writes nothing, and
    columns other than the three named are not read.
    """
    rows = with_holders(pages, key=key, url=url, html=html, least=least)
    files = normalise(write_archives(rows, f"{folder}/whole", level=level), f"{folder}/records", level=level)
    return Scratch(pages.sparkSession, "warc-files").save(files)
