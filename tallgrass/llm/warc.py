"""WARC archives: a writer, and a reader that salvages what damage leaves.

The writer puts each record into a gzip member of its own (or none, for plain archives). The reader takes member after member; where a
member or a version line is not where it should be, does not inflate, or fails its length or digest check, it looks for the next place where
a valid member or version line begins, goes on there, and reports the bytes between as a quarantined gap. Within a member that inflates but does
not hold just one sound record, it goes on at the next version line in the same way; records and gaps found there have the member's offsets,
and a gap's reason says which bytes of the content it is. It reads in pieces and holds one member or plain record at a time.

Of equal payloads of at least ``least_revisit`` bytes the one with the smallest page id is a response and the others are revisits that refer to it.

Defined cases: a null html is an empty payload; a null url leaves the target out; line ends in a url are percent-encoded; a null page id is
written as such, never chosen as a revisit and never referred to; rows with equal page id and payload are all responses if that id is
the smallest; an empty table writes no files; other columns are ignored. A member or plain record of more than ``_MOST`` inflated bytes is reported as a gap; that is more
than any text that Spark can hold, so no page that was written is lost by it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import cut, fresh_path
from tallgrass.llm.files import new_file, place

_MAGIC, _VERSION, _END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
_LINE = re.compile(rb"WARC/1\.\d\r\n")
_PIECE = 1 << 20
#: A value in Spark has fewer than 2 ** 31 bytes, a url is one and a payload is one.
_MOST = (3 << 31) + _PIECE
#: A file is closed when it has so many bytes.
_FILE_BYTES = 128 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD = "uri string, offset long, end long, kind string, reason string, record_id string, target_uri string, digest string, payload_length long, refers_to string, payload binary"


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit has the payload's length and digest but not the payload."""
    block = _HTTP % len(payload) + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


class _Source:
    """Bytes of a stream from ``at`` on; what lies before is forgotten."""

    def __init__(self, stream: BinaryIO):
        self._stream, self.buffer, self.at, self.over = stream, b"", 0, False

    def more(self) -> bool:
        piece = b"" if self.over else self._stream.read(_PIECE)
        self.over = self.over or not piece
        self.buffer += piece
        return bool(piece)

    def need(self, n: int) -> bool:
        while len(self.buffer) < n and self.more():
            pass
        return len(self.buffer) >= n

    def skip(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n


def _differs(said: str, block: bytes) -> bool:
    """Whether ``block`` fails the digest ``said``: an algorithm's name and the value in hexadecimal or base 32. Unknown algorithms are not checked."""
    name, _, value = said.partition(":")
    if name.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return False
    digest = hashlib.new(name.lower(), block).digest()
    return value.lower().rstrip("=") not in (digest.hex(), base64.b32encode(digest).decode().lower().rstrip("="))


def _parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, length of the record) of a record that begins at ``at``; ValueError says what is wrong."""
    end = raw.find(_END, at)
    if not raw.startswith(_VERSION, at) or end < 0:
        raise ValueError("no version line or header")
    headers = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("broken header")
        field = name.strip().lower().decode("latin-1")
        if field in headers and field != "warc-concurrent-to":  # two records' headers run into each other
            raise ValueError("repeated header")
        headers[field] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("no length")
    n = int(headers["content-length"])
    block = raw[end + 4 : end + 4 + n]
    if len(block) < n or raw[end + 4 + n : end + 8 + n] != _END:
        raise ValueError("length check failed")
    if _differs(headers.get("warc-block-digest", ""), block):
        raise ValueError("digest check failed")
    return headers, block, end + 8 + n - at


def _within(raw: bytes) -> Iterator[tuple[str | None, dict[str, str], bytes]]:
    """(reason, headers, block) of each record, reason None, and of each gap in the content of a member."""

    def gap(first: int, last: int, reason: str) -> tuple[str, dict[str, str], bytes]:
        return (reason if (first, last) == (0, len(raw)) else f"{reason}: bytes {first} to {last} of the member's content"), {}, b""

    at, since, why = 0, None, ""
    while at < len(raw):
        try:
            headers, block, n = _parse(raw, at)
        except ValueError as e:
            if since is None:
                since, why = at, str(e)
            at = raw.find(_VERSION, at + 1)
            if at < 0:
                break
            continue
        if since is not None:
            yield gap(since, at, why)
            since = None
        yield None, headers, block
        at += n
    if since is not None or not raw:
        yield gap(since or 0, len(raw), why or "the member is empty")


def _inflate(source: _Source) -> tuple[bytes, int]:
    """(content, size) of the gzip member that begins at the source."""
    member, out, size, used = zlib.decompressobj(31), [], 0, 0
    while not member.eof:
        if used == len(source.buffer) and not source.more():
            raise ValueError("the member is cut off")
        piece = source.buffer[used : used + _PIECE]
        used += len(piece)
        try:
            out.append(member.decompress(piece, _MOST - size + 1))
        except zlib.error as e:
            raise ValueError("the member does not inflate") from e
        size += len(out[-1])
        if size > _MOST or member.unconsumed_tail:
            raise ValueError("the member is too long")
    return b"".join(out), used - len(member.unused_data)


def _plain(source: _Source) -> tuple[dict[str, str], bytes, int]:
    """The plain record that begins at the source."""
    end, seen = -1, 0
    while source.need(len(_VERSION) + 3) and _LINE.match(source.buffer) and (end := source.buffer.find(_END, seen)) < 0:
        seen = len(source.buffer) - len(_END) + 1
        if len(source.buffer) > _MOST or not source.more():
            break
    length = next((x.partition(b":")[2].strip() for x in source.buffer[: max(end, 0)].lower().split(b"\r\n") if x.startswith(b"content-length:")), b"")
    if length.isdigit() and int(length) <= _MOST:
        source.need(end + 8 + int(length))
    return _parse(source.buffer)


def _begins(source: _Source, at: int) -> bool:
    """Whether a gzip member with a record, or a record, begins ``at`` bytes on."""
    source.need(at + 512)
    if source.buffer.startswith(_VERSION, at):
        return True
    try:
        return zlib.decompressobj(31).decompress(source.buffer[at : at + 512], len(_VERSION)).startswith(_VERSION)
    except zlib.error:
        return False


def _resync(source: _Source) -> int:
    """Bytes to the next place, past the first byte, where a member or version line begins; to the end if there is none."""
    at = 1
    while True:
        places = [p for p in (source.buffer.find(_MAGIC, at), source.buffer.find(_VERSION, at)) if p >= 0]
        if places:
            if _begins(source, at := min(places)):
                return at
            at += 1
        else:
            at = max(at, len(source.buffer) - len(_VERSION) + 1)
            if not source.more():
                return len(source.buffer)


def salvage(stream: BinaryIO) -> Iterator[tuple[int, int, str | None, dict[str, str], bytes]]:
    """(offset, end, reason, headers, block) of each record, reason None, and of each gap, with its reason and no block."""
    source = _Source(stream)
    while source.need(1):
        begin = source.at
        try:
            if source.need(3) and source.buffer.startswith(_MAGIC):
                raw, size = _inflate(source)
                found = _within(raw)
            else:
                headers, block, size = _plain(source)
                found = iter([(None, headers, block)])
        except ValueError as e:
            source.skip(_resync(source))
            yield begin, source.at, str(e), {}, b""
            continue
        source.skip(size)
        for reason, headers, block in found:
            yield begin, source.at, reason, headers, block


def plan_records(pages: DataFrame, least_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # only digests and ids are grouped; payloads that nothing else equals find no partner below
    first = rows.where(F.octet_length("payload") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    joined = rows.join(first.select(F.col("digest").alias("_digest"), "first"), F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_warc(planned: DataFrame, folder: str | None = None, compress: bool = True, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``plan_records`` as archives into ``folder`` (one of its own in the shared folder, if not given). Returns a row for each file, stored: uri, n_records."""
    folder = folder or fresh_path(planned.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, uri, n, part = None, "", 0, TaskContext.get().partitionId()
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if sink is None:
                    uri, system, path = new_file(folder, f"part-{part:06d}", ".warc.gz" if compress else ".warc")
                    sink, n = system.open_output_stream(path, compression=None), 0
                kind = "response" if refers is None else "revisit"
                data = record_bytes(kind, f"urn:page:{'' if page is None else page}", url, payload, digest, f"urn:page:{refers}", date)
                sink.write(gzip.compress(data, 3, mtime=0) if compress else data)
                n += 1
                if sink.tell() >= _FILE_BYTES:
                    sink.close()
                    done.append((uri, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((uri, n))
        yield pa.RecordBatch.from_pydict({"uri": pa.array([x[0] for x in done], pa.string()), "n_records": pa.array([x[1] for x in done], pa.int64())})

    return cut(planned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "uri string, n_records long"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """The records and gaps of the archives in ``files`` (uri), as RECORD: kind is response, revisit, another type of record, or gap (with its
    reason); offset and end are bytes of the file. The payload of a revisit is empty; its length and digest are the full payload's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = place(uri)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for begin, end, reason, headers, block in salvage(stream):
                        http, cut_at, payload = block.partition(_END)
                        if reason is None and "application/http" not in headers.get("content-type", ""):
                            payload = block
                        said = next((x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"") if cut_at else b""
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        kind = "gap" if reason else headers.get("warc-type")
                        length = int(said) if kind == "revisit" and said.isdigit() else len(payload)
                        ids = [headers[k].strip("<>") if k in headers else None for k in ("warc-record-id", "warc-refers-to")]
                        rows.append((uri, begin, end, kind, reason, ids[0], headers.get("warc-target-uri"), digest, length, ids[1], payload))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, files.count())
    return files.select("uri").repartitionByRange(n, "uri").mapInArrow(run, RECORD)
