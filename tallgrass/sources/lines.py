"""Text files as numbered lines, read by ranges.

A plain file is cut into ranges of bytes that any task reads: a range begins after the first line end at or behind its first byte but one, and ends with the line that its last byte is in. A file in gzip, told by its first two
bytes whatever its name, is one range, read as a stream. Ranges give pieces of whole lines; the number of a line is the number of lines in the pieces before, plus its place. No file is a row.

The store has to be one that Arrow opens. Defined cases: an empty file has no lines; a last line without an end counts; blank lines count; a carriage return before a line's end is dropped."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.functions.store import stored

PIECE, RANGE = 4 << 20, 64 << 20  # bytes of lines in a row, and of a file in a task


def open_file(path: str):
    """A file of the store, from which any place can be read."""
    store, name = fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:") and "://" not in path else path)
    return store.open_input_file(name)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at a path; what they hold is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Small work items, one to a partition while there are not too many."""
    return rows.repartitionByRange(max(1, min(rows.count(), 10_000)), *keys)


def whole_lines(stream, size: int) -> Iterator[str]:
    """Pieces of whole lines, each without the end of its last one."""
    rest = b""
    while data := stream.read(size):
        whole, cut, rest = (rest + data).rpartition(b"\n")
        if cut:
            yield whole.decode()
    if rest:
        yield rest.decode()


def numbered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, line) of pieces (keys, first, piece, text), in the order of first and piece; ``at`` counts from 0."""
    kept = stored(pieces, "line-pieces")
    counted = kept.select(*keys, "first", "piece", F.size(F.split("text", "\n")).alias("n"))
    before = Window.partitionBy(*keys).orderBy("first", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    begins = counted.select(*keys, "first", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    each = kept.join(begins, [*keys, "first", "piece"]).select(*keys, "begin", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return each.select(*keys, (F.col("begin") + F.col("k")).alias("at"), F.rtrim("line", F.lit("\r")).alias("line"))


class _Range:
    """The whole lines of a stretch of a file, as a file."""

    def __init__(self, f, first: int, last: int):
        self._f, self._at, self._last = f, max(0, first - 1), last
        f.seek(self._at)
        if first:
            self._skip()

    def _skip(self) -> None:
        """Go behind the next line end; the byte before the range may be one."""
        while data := self._f.read(1 << 16):
            cut = data.find(b"\n")
            if cut >= 0:
                self._at += cut + 1
                self._f.seek(self._at)
                return
            self._at += len(data)

    def read(self, size: int) -> bytes:
        if self._at >= self._last:
            return b""
        data = self._f.read(min(size, self._last - self._at))
        self._at += len(data)
        if self._at >= self._last and data and not data.endswith(b"\n"):  # to the end of the last line
            while more := self._f.read(1 << 16):
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
                if cut >= 0:
                    break
        return data


def read_lines(spark: SparkSession, path: str, piece: int = PIECE, stretch: int = RANGE) -> DataFrame:
    """(path, at, line) of text files, plain or in gzip."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with open_file(p) as f:
                    packed = f.read(2) == b"\x1f\x8b"
                firsts = [0] if packed else list(range(0, n, stretch))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(firsts)), pa.array(firsts, pa.int64()), pa.array([n if packed else min(n, a + stretch) for a in firsts], pa.int64()), pa.array([packed] * len(firsts))], ["path", "first", "last", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, first, last, packed in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "last", "packed")), strict=True):
                with open_file(p) as f:
                    stream = gzip.GzipFile(fileobj=f) if packed else _Range(f, first, last)
                    for k, text in enumerate(whole_lines(stream, piece)):
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([first]), pa.array([k]), pa.array([text])], ["path", "first", "piece", "text"])

    work = stored(dealt(files(spark, path), "path").mapInArrow(ranges, "path string, first long, last long, packed boolean"), "line-ranges")
    return numbered(dealt(work, "path", "first").mapInArrow(run, "path string, first long, piece long, text string"), ["path"])
