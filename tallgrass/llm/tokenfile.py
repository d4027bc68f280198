"""Token files: Arrow IPC files of fixed-size-list batches.

Documents are put in the order of their ids by a range shuffle; each range becomes a file. A file holds its tokens packed
into sequences of ``length``, a batch of ``rows`` sequences at a time, as ``ids`` (fixed-size list of the smallest unsigned type that
holds the vocabulary) and ``mask`` (fixed-size list of booleans, one bit each; false only behind the file's last token). All batches
but the last have the same size, so place p of a file is in batch p // (rows * length), and a sequence is a view of the mapped file:
nothing is copied or decoded. A second, small file lists doc_id, start and n_tokens of its documents.

Encoding uses the tokenizers library, once for each word that a task has not met lately: the words of a text are encoded one by one
by this kind of vocabulary, so their ids in a row are the text's ids.

Defined cases: a null text is empty and has the end id alone; a very long text is held by one task, with its ids; a null id comes first; rows with equal ids
follow each other by text, and may be dealt over several files; equal rows are all written; an empty table writes no documents; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallgrass.llm.bpe import Memory, Splitter, byte_symbols
from tallgrass.llm.common import cut, fresh_path
from tallgrass.llm.files import new_file, place


class Encoder:
    """ids of a text by the tokenizers library, word by word; the end id follows."""

    def __init__(self, path: str, end_id: int):
        self._words = Splitter(path)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self._end = np.array([end_id], "<u4").tobytes()
        tokenize, added, symbols = library.model.tokenize, self._words.added, {b: s for b, s in enumerate(byte_symbols())}

        def ids(word: str) -> bytes:
            """By the library's model alone: the splitter has already done what comes before it."""
            found = [added[word]] if word in added else [t.id for t in tokenize(word.encode().decode("latin-1").translate(symbols))]
            return np.array(found, "<u4").tobytes()

        self._memory = Memory(ids)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._memory.__getitem__, self._words(text or ""))) + self._end, "<u4")


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class Writer:
    """Packs documents into one token file and its list of documents."""

    def __init__(self, folder: str, part: int, length: int, rows: int, dtype: str):
        self.uri, system, path = new_file(folder, f"part-{part:06d}", ".arrow")
        self._length, self._rows, self._dtype = length, rows, np.dtype(dtype)
        kinds = pa.list_(pa.from_numpy_dtype(self._dtype), length), pa.list_(pa.bool_(), length)
        self._schema = pa.schema([pa.field("ids", kinds[0]), pa.field("mask", kinds[1])], {"rows": str(rows), "length": str(length)})
        self._sink, self._list_sink = system.open_output_stream(path), system.open_output_stream(f"{path}.docs")
        self._file, self._list = pa.ipc.new_file(self._sink, self._schema), None
        self._held, self._n_held, self.n_tokens, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, documents: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in documents], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        batch = pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], ["doc_id", "start", "n_tokens"])
        if self._list is None:
            self._list = pa.ipc.new_file(self._list_sink, batch.schema)
        self._list.write_batch(batch)
        self.n_tokens += int(sizes.sum())
        self.n_docs += len(documents)
        self._held += [x.astype(self._dtype) for x in documents]
        self._n_held += int(sizes.sum())
        if self._n_held >= self._rows * self._length:
            flat, whole = np.concatenate(self._held), self._rows * self._length
            for at in range(0, len(flat) - whole + 1, whole):
                self._write(flat[at : at + whole], whole)
            self._held = [flat[len(flat) // whole * whole :]]
            self._n_held = len(self._held[0])

    def _write(self, flat: np.ndarray, n: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self._length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < n), self._length)
        self._file.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self._schema))

    def close(self) -> None:
        if self._n_held:
            flat = np.concatenate(self._held)
            self._write(np.pad(flat, (0, -len(flat) % self._length)), len(flat))
        self._file.close()
        self._sink.close()
        if self._list is not None:
            self._list.close()
        self._list_sink.close()


class TokenFile:
    """Random access to a token file; local files are mapped."""

    def __init__(self, uri: str):
        system, path = place(uri)
        source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self._file = pa.ipc.open_file(source)
        meta = self._file.schema.metadata
        self.length = int(meta[b"length"])
        self._whole = self.length * int(meta[b"rows"])
        self.documents = pa.ipc.open_file(system.open_input_file(f"{path}.docs"))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence i; the ids are a view."""
        batch = self._file.get_batch(i * self.length // self._whole)
        at = i % (self._whole // self.length)
        return batch.column(0)[at].values.to_numpy(zero_copy_only=True), batch.column(1)[at].values

    def span(self, start: int, n: int) -> np.ndarray:
        """The ids of places start ... start + n; a view if they are in one batch."""
        parts = []
        for k in range(start // self._whole, (start + n - 1) // self._whole + 1):
            flat = self._file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            parts.append(flat[max(0, start - k * self._whole) : start + n - k * self._whole])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_tokens(docs: DataFrame, path: str, end_id: int, n_vocab: int, length: int = 2048, rows: int = 256, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` into ``folder`` (one of its own in the shared folder, if not given). Returns a row for each file,
    stored: part, uri, n_docs, n_tokens, base (tokens in the files before). ``path`` is the vocabulary file, there on every executor."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    dtype = "uint16" if n_vocab <= 1 << 16 else "uint32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, part = encoder(path, end_id), None, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                writer = writer or Writer(folder, part, length, rows, dtype)
                writer.add(piece.column(0), [encode(x) for x in piece.column(1).to_pylist()])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [writer.uri], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    placed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    files = cut(placed.mapInArrow(run, "part int, uri string, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The documents of token files: doc_id, start (tokens of all documents before), ids (little-endian unsigned 32-bit, binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                for k in range(file.documents.num_record_batches):
                    listed = file.documents.get_batch(k)
                    starts, sizes = listed.column(1).to_numpy(), listed.column(2).to_numpy()
                    ids = [file.span(int(s), int(n)).astype("<u4").tobytes() for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([listed.column(0), pa.array(starts + base), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    n = max(1, files.count())
    return files.repartitionByRange(n, "part").select("uri", "base").mapInArrow(run, f"doc_id {id_type}, start long, ids binary")
