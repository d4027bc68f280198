"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes (a window) that covers it also starts anywhere else. Each window is found under its anchor: the place in it
where a hash of ``_GRAM`` bytes is smallest. The anchor depends on the window alone, so both places of a repeated window have it at the same offset.
Windows that follow each other, share an anchor and have it at nearly the same offset (one of ``_RANGES`` ranges) make one piece; every window of a text is in
exactly one piece. The windows of a range have a core of bytes in common, and pieces with equal cores make a group: repeated windows are in one group.

1. texts to pieces: group, hash, place;
2. groups that are there once are dropped, equal pieces are counted. A piece that is there twice is repeated as a whole. Groups with several different pieces
   stay, one copy of each;
3. the bytes of those pieces go to shards by group; each shard builds its suffix array by induced sorting and the permuted common prefixes, and a
   window is repeated if its neighbour in the array shares ``length`` bytes;
4. repeated windows come back to every text that has the piece, by a join, and the bytes that they cover are cut out.

A group of more than ``most_in_group`` different pieces is not left to one task. Its range of offsets is split (``_split``): the windows of a part have more in
common, the group falls apart by those bytes, equal pieces are counted and one of each goes on, until every group is small or its pieces are all equal.

Copies of a text share their pieces, so nothing grows with the pairs in a group, and a group's texts meet nowhere.

A piece is identified by two 64-bit hashes, of its group's core and of itself: only pieces of one group are told apart by 64 bits alone. Groups only bring pieces together;
a group that two cores share costs time and changes nothing. Texts are identified by their id and a 64-bit hash.

Defined cases: a null text is empty; a text shorter than ``length`` loses nothing; a very long text is cut into overlapping blocks of ``_BLOCK`` bytes, each window in exactly
one; a null id is fine; repeated rows are copies of each other; ties of an anchor's hash go to the leftmost, in every text alike; an empty table gives no rows; other columns are
ignored or, in ``drop_repeats``, passed through, and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import cut, text_key
from tallgrass.llm.induced import common_prefixes, suffix_array

#: Bytes that an anchor's hash covers, and ranges of its offsets.
_GRAM, _RANGES = 32, 2
#: Bytes of text that are hashed at once, and bytes of pieces that make one suffix array.
_BLOCK, _SHARD = 1 << 20, 1 << 20
#: Bits that number the places of a block, which has less than two _BLOCKs; the rest of a word holds the hash.
_PLACE = 22
#: The window of the passages that the pipeline cuts out: no passage of 51 words that was met in the test tables is shorter.
PASSAGE = 240
#: Parts of a range in one split.
_PARTS = 8
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """The hash of the _GRAM bytes from each place on; the last places have none."""
    h, base, size = data.astype(np.uint64) + np.uint64(1), np.uint64(_ODD), 1
    with np.errstate(over="ignore"):
        while size < _GRAM:
            h = h[:-size] * base + h[size:]
            base, size = base * base, 2 * size
        return _mix(h)


def range_size(length: int) -> int:
    return -(-(length - _GRAM + 1) // _RANGES)


def pieces(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the texts that lie in ``data`` up to ``ends``: text number, first window's start, number of windows, and the anchor's offset in the
    first window, of each piece. Places count from the begin of ``data``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < length:
        return none
    h = _grams(data)
    width = length - _GRAM + 1  # grams in a window
    if len(h) >> _PLACE:
        raise ValueError("a block is too long")
    bits = np.uint64(_PLACE)
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost is the smallest
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(ends, start, side="right")
    inside = start + length <= ends[text]
    kind = (anchor - start) // range_size(length)
    changed = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (kind[1:] != kind[:-1])
    new = inside & np.r_[True, ~inside[:-1] | changed]
    first = np.flatnonzero(new)
    if not len(first):
        return none
    return text[first], first, np.bincount(np.cumsum(new)[inside] - 1), anchor[first] - first


def core(piece: bytes, offset: int, low: int, high: int, length: int) -> bytes:
    """What all windows of a range have in common, from a piece whose first window has the anchor at ``offset``."""
    return piece[offset - low : offset - high + length]


def _hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


#: at: the first window's start << 32, the number of windows << 16, and the anchor's offset in the first window.
_PLACES = "doc_id {}, key long, at long, part long, piece long"


def _places(docs: DataFrame, length: int) -> DataFrame:
    """The pieces of all texts (doc_id, key, text)."""
    step, most = range_size(length), length - _GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            whole = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)
            n_cuts = np.maximum(1, -(-(whole - length + 1) // _BLOCK))  # windows begin in one cut each
            of_text = np.repeat(np.arange(len(texts)), n_cuts)
            origin = (np.arange(len(of_text)) - np.repeat(np.cumsum(n_cuts) - n_cuts, n_cuts)) * _BLOCK
            sizes = np.minimum(whole[of_text] - origin, _BLOCK + length - 1)
            block = np.cumsum(sizes) // (_BLOCK + length)
            for rows in np.split(np.arange(len(of_text)), np.flatnonzero(np.diff(block)) + 1):
                if not len(rows):
                    continue
                raw = b"".join(memoryview(texts[int(of_text[i])].as_buffer())[origin[i] : origin[i] + sizes[i]] for i in rows)
                ends = np.cumsum(sizes[rows])
                text, first, windows, offset = pieces(np.frombuffer(raw, np.uint8), ends, length)
                parts, hashes = [], []
                for a, n, o in zip(first.tolist(), windows.tolist(), offset.tolist(), strict=True):
                    low = o // step * step
                    data = raw[a : a + n + length - 1]
                    parts.append(_hash(core(data, o, low, min(low + step - 1, most), length), low))
                    hashes.append(_hash(data))
                of = pa.array(of_text[rows[text]])
                begin = first - np.r_[0, ends[:-1]][text] + origin[rows[text]]
                arrays = [batch.column("doc_id").take(of), batch.column("key").take(of), pa.array(begin << 32 | windows << 16 | offset), _signed(parts), _signed(hashes)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "at", "part", "piece"])

    rows = docs.where(F.octet_length("text") >= length).select("doc_id", "key", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _PLACES.format(docs.schema["doc_id"].dataType.simpleString()))


_PIECE = "part long, piece long, n long, pieces long, at long, data binary"


def _bytes_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the pieces in ``wanted`` (doc_id, key, at, part, piece, n, pieces)."""
    lists = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("part", "piece", "n", "pieces", "at")).alias("places"))  # of one text
    lists = lists.withColumnsRenamed({"key": "_key", "doc_id": "_id"})
    rows = docs.select("doc_id", "key", F.col("text").cast("binary").alias("text")).join(lists, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                places, texts = part.column(1), part.column(0)
                flat = places.flatten()
                of = np.repeat(np.arange(len(places)), np.array(places.value_lengths()))
                at = flat.field(4).to_numpy()
                raw = [memoryview(x.as_buffer()) for x in texts]
                ends = (at >> 32) + (at >> 16 & 0xFFFF) + length - 1
                data = [raw[t][a:b].tobytes() for t, a, b in zip(of.tolist(), (at >> 32).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(flat.field(i) for i in range(5)), pa.array(data, pa.binary())], ["part", "piece", "n", "pieces", "at", "data"])

    return rows.select("text", "places").mapInArrow(run, _PIECE)


#: A part of a piece: its windows from number ``lo`` on; the group's offsets are ``low`` ... ``high``.
_SLICE = "part long, piece long, n long, lo int, windows int, low int, high int, sub long, own long"


def _split(crowd: DataFrame, length: int) -> DataFrame:
    """Each row of ``crowd`` (part, piece, n, offset, lo, low, high, data) once for each part of its range that it has windows of, with
    sub (the group that they fall to) and own (the hash of their bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _SLICE.split(", ")]
        for batch in batches:
            out = []
            for part, piece, n, offset, lo, low, high, data in zip(*(batch.column(k).to_pylist() for k in ("part", "piece", "n", "offset", "lo", "low", "high", "data")), strict=True):
                windows, step = len(data) - length + 1, -(-(high - low + 1) // _PARTS)
                for a in range(low, high + 1, step):
                    b = min(a + step - 1, high)
                    first, last = max(0, offset - b), min(windows - 1, offset - a)
                    if first <= last:
                        some = data[first : last + length]
                        sub = _hash(core(some, offset - first, a, b, length), (part ^ a << 16 ^ b) & 0xFFFFFFFFFFFFFFFF)
                        out.append((part, piece, n, lo + first, last - first + 1, a, b, sub, _hash(some)))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 3 + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), _signed(columns[7]), _signed(columns[8])], names)

    return crowd.select("part", "piece", "n", "offset", "lo", "low", "high", "data").mapInArrow(run, _SLICE)


def _repeated(data: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, the starts of windows that are also elsewhere in ``data``, by one suffix array."""
    sizes = np.array([len(x) for x in data])
    text = np.zeros(int(sizes.sum()) + len(data) + 1, np.int32)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = inside[-1] = False
    text[inside] = np.frombuffer(b"".join(data), np.uint8).astype(np.int32) + 2
    text[ends - 1] = 1
    room = np.r_[np.repeat(ends - 1, sizes + 1) - np.arange(len(text) - 1), 0]
    sa = suffix_array(text, 258)
    shared = common_prefixes(text, sa, room)
    found = np.zeros(len(text), bool)
    hit = np.flatnonzero(shared[sa] >= length)  # an entry and the one before it in the array
    found[sa[hit]] = found[sa[hit - 1]] = True
    return [np.flatnonzero(x) for x in np.split(found[:-1], ends[:-1])]


_RUNS = "part long, piece long, runs array<struct<first:int,last:int>>"


def _runs(starts: np.ndarray) -> list[dict[str, int]]:
    new = np.flatnonzero(np.r_[True, np.diff(starts) > 1]) if len(starts) else np.zeros(0, int)
    return [{"first": int(starts[a]), "last": int(starts[b - 1])} for a, b in zip(new, np.r_[new[1:], len(starts)], strict=True)]


def _sort_shards(groups: DataFrame, length: int) -> DataFrame:
    """The repeated windows of the pieces in ``groups`` (grp, part, piece, lo, data), each group's together in one shard. Windows count from the piece's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        kind = pa.struct([("first", pa.int32()), ("last", pa.int32())])
        schema = pa.schema([("part", pa.int64()), ("piece", pa.int64()), ("runs", pa.list_(kind))])

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            found = _repeated([x[3] for x in held], length)
            rows = [{"part": p, "piece": q, "runs": _runs(starts + lo)} for (p, q, lo, _), starts in zip(held, found, strict=True) if len(starts)]
            held, size = [], 0
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for grp, *row in zip(*(batch.column(k).to_pylist() for k in ("grp", "part", "piece", "lo", "data")), strict=True):
                if grp != last and size >= _SHARD:
                    yield flush()
                if grp == last and held and held[-1][:3] == tuple(row[:3]):
                    continue  # the same piece from an equal row
                held.append(tuple(row))
                size += len(row[3])
                last = grp
        if held:
            yield flush()

    cols = ["grp", "part", "piece", "lo"]
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # sorting is dear for its bytes: partitions are not to be merged by size
    return groups.repartition(n, "grp").sortWithinPartitions(*cols).select(*cols, "data").mapInArrow(run, _RUNS)


def _crowded_runs(crowd: DataFrame, length: int, most_in_group: int) -> DataFrame:
    """The repeated windows of the pieces in ``crowd`` (_PIECE, stored), whose groups are too large for one task; as _RUNS. Only hashes are counted; bytes
    are taken from ``crowd`` where they are needed."""
    step, most = range_size(length), length - _GRAM
    offset = F.col("at").bitwiseAND(F.lit(0xFFFF)).cast("int")
    base = crowd.select("part", "piece", "n", offset.alias("offset"), "data")
    low = (F.floor(F.col("offset") / step) * step).cast("int")
    level = base.withColumn("lo", F.lit(0)).withColumn("low", low).withColumn("high", F.least(F.col("low") + (step - 1), F.lit(most)))
    found = None
    while True:
        slices = cut(_split(level, length), "suffix-slices")
        rep = F.min(F.struct("part", "piece", "lo")).alias("rep")
        own = slices.groupBy("sub", "own").agg(F.sum("n").alias("times"), rep)
        several = own.groupBy("sub").agg(F.count("*").alias("pieces"))
        known = cut(own.join(several, "sub").where("times > 1 or pieces > 1"), "suffix-owns")
        joined = slices.join(known, ["sub", "own"])
        whole = F.array(F.struct(F.col("lo").alias("first"), (F.col("lo") + F.col("windows") - 1).alias("last")))
        twice = joined.where("times > 1").select("part", "piece", whole.alias("runs"))
        left = joined.where("pieces > 1").where(F.struct("part", "piece", "lo") == F.col("rep"))
        left = cut(left.select("sub", "part", "piece", "n", "lo", "windows", "low", "high", "pieces"), "suffix-left")  # pieces: of the sub-group
        data = F.substring("data", F.col("lo") + 1, F.col("windows") + (length - 1))
        taken = left.join(base.select("part", "piece", "offset", "data"), ["part", "piece"]).withColumn("data", data)
        few = _sort_shards(taken.where(f"pieces <= {most_in_group}").select(F.col("sub").alias("grp"), "part", "piece", "lo", "data"), length)
        part = twice.union(few)
        found = part if found is None else found.union(part)
        if left.where(f"pieces > {most_in_group}").isEmpty():  # a range of one offset has no group of several pieces
            return found
        level = taken.where(f"pieces > {most_in_group}").withColumn("offset", F.col("offset") - F.col("lo"))


def repeated_spans(docs: DataFrame, length: int = 400, most_in_group: int = 1000) -> DataFrame:
    """(doc_id, key, first, last): bytes first ... last (last excluded) of the text are covered by windows that are also elsewhere; spans may be
    there again and overlap. ``docs`` has doc_id, key (of the text) and text."""
    if not _GRAM < length < 1 << 15:
        raise ValueError(f"length has to be over {_GRAM} and below {1 << 15}")
    places = cut(_places(docs, length), "suffix-places")
    again = cut(places.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part"), "suffix-parts")
    # the join only marks rows, which are stored, so Spark can split a crowded group; what is grouped next is dealt by piece as well
    places = cut(places.join(again, "part", "left_semi"), "suffix-kept")
    one = [F.first(c).alias(c) for c in ("doc_id", "key", "at")]  # of one row
    distinct = cut(places.groupBy("part", "piece").agg(F.count("*").alias("n"), *one), "suffix-distinct")
    several = cut(distinct.groupBy("part").agg(F.count("*").alias("pieces")).where("pieces > 1"), "suffix-several")
    taken = cut(_bytes_of(docs, distinct.join(several, "part"), length), "suffix-bytes")  # texts are shuffled once for all groups
    crowded = F.col("pieces") > most_in_group
    runs = _sort_shards(taken.where(~crowded).select(F.col("part").alias("grp"), "part", "piece", F.lit(0).alias("lo"), "data"), length)
    crowd = taken.where(crowded)
    if not crowd.isEmpty():
        runs = runs.union(_crowded_runs(cut(crowd.dropDuplicates(["part", "piece"]), "suffix-crowd"), length, most_in_group))
    windows = F.shiftright("at", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("first"), (windows - 1).alias("last")))
    runs = cut(distinct.where("n > 1").select("part", "piece", whole.alias("runs")).union(runs), "suffix-runs")
    begin = F.shiftright("at", 32).cast("int")
    return (
        places.join(runs, ["part", "piece"])
        .select("doc_id", "key", begin.alias("begin"), F.explode("runs").alias("run"))
        .select("doc_id", "key", (F.col("begin") + F.col("run.first")).alias("first"), (F.col("begin") + F.col("run.last") + length).alias("last"))
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), text.alias("text"))


def cut_spans(text: bytes, spans: list[dict[str, int]] | None) -> tuple[list[dict[str, int]], bytes]:
    """(the maximal runs that the spans cover, the bytes outside them)."""
    runs: list[list[int]] = []
    for first, last in sorted((x["first"], x["last"]) for x in (() if spans is None else spans)):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    edges = [0, *(x for run in runs for x in run), len(text)]
    return [{"first": a, "last": b} for a, b in runs], b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _spans_of(docs: DataFrame, length: int) -> DataFrame:
    """(_tg_id, _tg_text, _tg_spans): the spans of each text that has any, each once."""
    spans = repeated_spans(docs, length).groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("_tg_spans"))  # of one text
    return spans.withColumnsRenamed({"doc_id": "_tg_id", "key": "_tg_text"})


def _join_spans(rows: DataFrame, spans: DataFrame, id_col: str = "doc_id", key: str = "key") -> DataFrame:
    return rows.join(spans, (F.col(key) == F.col("_tg_text")) & F.col(id_col).eqNullSafe(F.col("_tg_id")), "left").drop("_tg_id", "_tg_text")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (removed: first, last excluded), kept (the other bytes)."""
    rows = keyed(docs, id_col, text_col)
    joined = _join_spans(rows, _spans_of(rows, length)).select("doc_id", F.col("text").cast("binary").alias("text"), "_tg_spans")
    kind = "array<struct<first:int,last:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, texts, spans = batch.slice(at, 512).columns
                texts = texts.to_pylist()
                runs, kept = zip(*map(cut_spans, texts, spans.to_pylist()), strict=True)
                arrays = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, spans_type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans {kind}, kept binary")


def drop_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts. Parts of a character that are left over go as well; a null text stays null."""

    @F.pandas_udf("string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([t if s is None else cut_spans(t.encode(), s)[1].decode(errors="ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"), own)
    joined = _join_spans(rows, _spans_of(keyed(docs, id_col, text_col), length))
    joined = joined.withColumn("text", kept("text", "_tg_spans"))
    return joined.select(*[F.col("text").alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
