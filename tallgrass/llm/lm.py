"""Document scores by a hashed maximum-entropy language model with a class-factored softmax.

log P(word | before) = log P(class | before) + log P(word | class). The class factor is a softmax over hashed features of the three words before: each word by its
distance (n-gram and skip features), the nearest two together, and the first and third together. The word factor is a softmax over hashed features as well, in one or two
steps (``Tree``): a class's most frequent words have outputs of their own, further words have one in a group, and words below a count share one, in which each has its smoothed
share. A softmax starts from the shares of its outputs, which are its bias, so without weights the word factor is the smoothed share of the word in its class.

1. word counts, by a grouped count;
2. every token becomes a number of four bytes, and the numbers of each text are stored once; later passes read these only;
3. classes: the most frequent words are classes of their own. Other words fall into buckets by their last bytes, and buckets are clustered by which
   of the frequent words come shortly before them;
4. weights, in rounds over all training texts. The texts are dealt into ``updates`` slices by a hash of id and numbers. For each slice in turn, tasks add up the gradient of its
   log-likelihood at the shared weights, the tables are summed over tasks by block of features, 32 at a time, and the weights take one step (adaptive rates). So the
   weights do not depend on how the texts lie in partitions. Both factors are fitted in the same passes.

The feature table grows with the words counted, up to ``most_features`` rows; the counted words grow without bound. What reaches the driver or is broadcast has sizes fixed by
parameters: features x classes and features x outputs (4 MB each), buckets x signals, and the ``head`` most frequent words. Scoring reads head words in place; the other words of a document are joined with the
stored counts.

Defined cases: a null text is empty, its only token the end; a very long text is read in pieces of ``batch`` tokens; a null id counts as the empty string for the held-out
rule; repeated rows are scored and counted as often as they are there; ties of counts go by word; an empty table gives no rows; unseen words take the unseen slot of their class; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import SPACE, ascii_lower, cut, split_words

#: The end of a text, as a token; no word has this string.
END = "\n"
_SUFFIX = 3  # bytes at a word's end that choose its bucket
_LAGS = (1, 2, 3)
_WORD_KINDS = (0, 3)  # the features of the word factor: the word before, and the two before
_NEVER = -200.0  # the log share of an output without words
_BOUND = 8.0  # of a weight, so that the exponential of a sum of them stays in single precision
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_TASK = 1 << 20  # tokens that one task takes in a slice
#: A token's number: the place of a head word, or this bit, ten bits of bucket and 21 bits of hash.
_TAIL, _HASH = 1 << 31, 21


@dataclass(frozen=True)
class Sizes:
    """The sizes that bound the model."""

    most_features: int = 1 << 15
    classes: int = 32
    singles: int = 16
    buckets: int = 1024
    signals: int = 64
    head: int = 1 << 16
    rounds: int = 2
    updates: int = 12
    batch: int = 1 << 15
    blocks: int = 16
    outputs: int = 32
    least: int = 64

    def features(self, n_words: int) -> int:
        """Rows of the feature table: a power of two, four words to a row, while there is room."""
        return min(self.most_features, max(1 << 12, 1 << (n_words // 4).bit_length()))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END.encode()]


def bucket_of(word: bytes, n: int) -> int:
    return zlib.crc32(word[-_SUFFIX:]) % n


def bucket_column(word: Column, n: int) -> Column:
    return (F.crc32(F.substring(word.cast("binary"), -_SUFFIX, _SUFFIX)) % n).cast("int")


class Numbers(dict):
    """word -> number."""

    def __init__(self, head: list[bytes], sizes: Sizes):
        super().__init__(zip(head, range(len(head)), strict=True))
        self._buckets = sizes.buckets

    def __missing__(self, word: bytes) -> int:
        return _TAIL | bucket_of(word, self._buckets) << _HASH | zlib.crc32(word) & (1 << _HASH) - 1


def before(values: np.ndarray, inside: np.ndarray, lag: int, none: int) -> np.ndarray:
    """The value ``lag`` tokens before each token of the same text; ``inside`` counts a token's place in its text."""
    out = np.full(len(values), none, values.dtype)
    out[lag:] = values[:-lag] if lag else values
    out[inside < lag] = none
    return out


def features(codes: np.ndarray, inside: np.ndarray, n: int) -> list[np.ndarray]:
    """The feature numbers of each token, one array for each kind of feature. ``n`` is a power of two."""
    past = [before(codes.astype(np.uint64) + np.uint64(1), inside, lag, 0) for lag in _LAGS]
    kinds = [*past, past[0] * np.uint64(31) + (past[1] << np.uint64(24)), past[0] * np.uint64(37) + (past[2] << np.uint64(25))]
    with np.errstate(over="ignore"):
        return [((x + np.uint64(1)) * m >> np.uint64(40)).astype(np.int64) & (n - 1) for x, m in zip(kinds, _MULTIPLIERS, strict=True)]


def raised(weights: np.ndarray, bias: np.ndarray, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The logits of each token's classes and their exponentials. Weights are bounded, so no row needs its maximum taken out."""
    logits = weights.take(kinds[0], axis=0)
    for f in kinds[1:]:
        logits += weights.take(f, axis=0)
    logits += bias
    return logits, np.exp(logits)


def log_class(weights: np.ndarray, bias: np.ndarray, kinds: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """log P(class | before) of each token's class."""
    logits, e = raised(weights, bias, kinds)
    return logits[np.arange(len(classes)), classes] - np.log(e @ np.ones(e.shape[1], e.dtype))


def gradient(weights: np.ndarray, bias: np.ndarray, kinds: list[np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each feature is met, the gradient of the log-likelihood of these tokens by the weights)."""
    p = raised(weights, bias, kinds)[1]
    p *= (-1 / (p @ np.ones(p.shape[1], p.dtype)))[:, None]
    p[np.arange(len(classes)), classes] += 1
    met, room = np.concatenate(kinds), np.empty((len(kinds), len(classes)))
    slope = np.empty(weights.shape[::-1], weights.dtype)
    for c, own in enumerate(np.ascontiguousarray(p.T)):
        room[:] = own
        slope[c] = np.bincount(met, room.reshape(-1), len(weights))
    return np.bincount(met, minlength=len(weights)), np.ascontiguousarray(slope.T)


class Tree:
    """The softmaxes of the word factor. Node k is that of class k: output 0 is shared by all words without one of their own, outputs 1 ... ``outputs`` / 2 are the most frequent
    words, each later output is a group of the next ``outputs`` words, with a node of its own. Single words and words of less than ``least`` training tokens get no output.

    first, group, second: of each head word its output in the class's node, the node of its group (or -1) and its output there. shared: of each class, the counts of
    output 0, all words' halves and the unseen slot included. bias: the log share of each output of a node."""

    def __init__(self, sizes: Sizes, head_class: np.ndarray, head_counts: np.ndarray, room: np.ndarray):
        n, half = sizes.outputs, sizes.outputs // 2
        n_groups = n - 1 - half
        self.first, self.second = np.zeros(len(head_class), np.int64), np.zeros(len(head_class), np.int64)
        self.group = np.full(len(head_class), -1, np.int64)
        mass = np.zeros((sizes.classes * (1 + n_groups), n))
        for k in range(sizes.singles, sizes.classes):
            own = np.flatnonzero((head_class == k) & (head_counts >= sizes.least))[: half + n_groups * n]  # in order of counts
            place, counts = np.arange(len(own)), head_counts[own] + 0.5
            at, self.second[own] = np.divmod(np.maximum(place - half, 0), n)
            grouped = place >= half
            self.first[own] = np.where(grouped, 1 + half + at, 1 + place)
            self.group[own] = np.where(grouped, sizes.classes + k * n_groups + at, -1)
            mass[k] = np.bincount(self.first[own], counts, n)
            mass[k, 0] = room[k] - counts.sum()
            np.add.at(mass, (self.group[own[grouped]], self.second[own[grouped]]), counts[grouped])
        self.shared = mass[: sizes.classes, 0].copy()
        total = mass.sum(1, keepdims=True)
        self.bias = np.where(mass > 0, np.log(np.where(mass > 0, mass, 1) / np.where(total > 0, total, 1)), _NEVER).astype(np.float32)
        self.has_words = (mass[: sizes.classes, 1:] > 0).any(1)

    def steps(self, codes: np.ndarray, classes: np.ndarray, kinds: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(token, node, feature numbers, output) of each softmax that the words of these tokens pass. ``kinds``: the feature numbers of the tokens."""
        place = np.where(codes >= _TAIL, len(self.first), codes).astype(np.int64)
        one = np.flatnonzero(self.has_words[classes])
        group = np.append(self.group, -1)[place]
        two = np.flatnonzero(group >= 0)
        token, node = np.concatenate([one, two]), np.concatenate([classes[one], group[two]])
        output = np.concatenate([np.append(self.first, 0)[place[one]], self.second[place[two]]])
        own = (node + 1) * 0x9E3779B1 >> 8  # a node's rows are those of all others in another order
        return token, node, [(kinds[i][token] ^ own) & (n - 1) for i in _WORD_KINDS], output


class Climber:
    """Weights that follow the gradient, each at a rate that falls with the gradients it has had."""

    def __init__(self, shape: tuple[int, int]):
        self.weights, self._squares = np.zeros(shape, np.float32), np.ones(shape, np.float32)

    def step(self, slope: np.ndarray, rate: float) -> None:
        self._squares += slope * slope
        self.weights = np.clip(self.weights + rate * slope / np.sqrt(self._squares), -_BOUND, _BOUND).astype(np.float32)


def cluster(near: np.ndarray, n: int, rounds: int = 20) -> np.ndarray:
    """Clusters 0 ... n - 1 of the buckets by the signals near them (buckets x signals, counts), by weighted k-means on their relative frequency."""
    total = near.sum(1)
    shared = (near.sum(0) + 1e-3) / (near.sum() + 1e-3 * near.shape[1])
    rates = np.sqrt((near + 20 * shared) / (total + 20)[:, None] / shared)
    rates = rates * np.sqrt(shared)
    heavy = np.argsort(-total, kind="stable")
    centres = rates[heavy[:1]]
    for _ in range(1, n):  # the next centre is the heaviest far point
        far = ((rates[:, None] - centres[None]) ** 2).sum(2).min(1) * np.sqrt(total + 1)
        centres = np.vstack([centres, rates[[int(far.argmax())]]])
    for _ in range(rounds):
        of = ((rates[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        weight = np.bincount(of, total + 1e-9, n)
        sums = np.stack([np.bincount(of, (total + 1e-9) * rates[:, j], n) for j in range(rates.shape[1])], 1)
        centres = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-12)[:, None], centres)
    return of


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 1


_PACKED = "held_out boolean, codes binary"


def _codes(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens of context at the begin, numbers, places inside the text, number of the text) of up to ``size`` tokens after the context, through the texts of a batch."""
    column = batch.column("codes")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    codes = np.frombuffer(column.buffers()[2], "<u4")[offsets[0] : offsets[-1]]
    starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
    for at in range(0, len(codes), size):
        lo, hi = max(0, at - max(_LAGS)), min(at + size, len(codes))
        text = np.searchsorted(starts, np.arange(lo, hi), side="right") - 1  # no text is without tokens
        yield at - lo, codes[lo:hi], np.arange(lo, hi) - starts[text], text


def _summed(tables: DataFrame, dtype: str, n_tasks: int) -> np.ndarray:
    """The sum over tasks of the tables (block, task, data), joined in the order of blocks. 32 tables of a block meet at a time, in as many levels as that takes."""

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = np.zeros(len(frame["data"].iloc[0]) // np.dtype(dtype).itemsize)
        for data in frame["data"]:
            total += np.frombuffer(data, dtype)
        return pd.DataFrame({"block": [int(key[0])], "task": [int(key[1])], "data": [total.astype(dtype).tobytes()]})

    while True:
        tables = tables.withColumnRenamed("task", "part").groupBy("block", F.expr("cast(part div 32 as int)").alias("task")).applyInPandas(add, "block int, task int, data binary")
        n_tasks = -(-n_tasks // 32)
        if n_tasks <= 1:
            break
    rows = tables.collect()  # as many rows as blocks, of a fixed size
    return np.concatenate([np.frombuffer(r["data"], dtype) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(0, dtype)


def _blocks(table: np.ndarray, n: int, dtype: str) -> pa.RecordBatch:
    parts = np.split(table.astype(dtype), n)
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({"block": pa.array(range(n), pa.int32()), "task": pa.array([task] * n, pa.int32()), "data": pa.array([x.tobytes() for x in parts], pa.binary())})


@dataclass
class Model:
    """What training leaves. ``counts`` (word, c) is a stored table; the rest has a fixed size."""

    sizes: Sizes
    counts: DataFrame
    n_tokens: int
    n_words: int
    head: list[bytes]
    head_counts: np.ndarray
    head_class: np.ndarray
    bucket_class: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    tree: Tree
    word_weights: np.ndarray

    def base_logs(self) -> np.ndarray:
        return np.log10((self.head_counts + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))

    def word_logs(self) -> np.ndarray:
        """What no softmax gives: log10 of each head word's share in the shared output of its class; 0 for words with outputs of their own."""
        logs = np.log10((self.head_counts + 0.5) / np.maximum(self.tree.shared[self.head_class], 0.5))
        logs[: self.sizes.singles] = 0.0
        logs[self.tree.first > 0] = 0.0
        return logs


def classes_of(codes: np.ndarray, head_class: np.ndarray, bucket_class: np.ndarray) -> np.ndarray:
    tail = codes >= _TAIL
    return np.where(tail, bucket_class[(codes >> _HASH) & 0x3FF], np.append(head_class, 0)[np.where(tail, len(head_class), codes).astype(np.int64)])


def _packed(rows: DataFrame, head: list[bytes], sizes: Sizes) -> DataFrame:
    """``rows`` (doc_id, held_out, text) with the numbers of their tokens, four bytes each, the words of each text that are not in the head, and the slice of training
    that the text belongs to (-1: none). Slices are folders, so a pass reads its own only."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, task = Numbers(shared.value, sizes), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, codes, tails = batch.slice(at, 256), [], []
                for text in part.column("text").to_pylist():
                    words = tokens(text)
                    own = np.fromiter(map(memory.__getitem__, words), np.uint32, len(words))
                    codes.append(own.astype("<u4").tobytes())
                    tails.append(Counter([words[i] for i in np.flatnonzero(own >= _TAIL).tolist()]))
                flat = [pa.array([w for t in tails for w in t], pa.binary()).cast(pa.string()), pa.array([n for t in tails for n in t.values()], pa.int32())]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tails)]), pa.int32()), pa.StructArray.from_arrays(flat, ["word", "times"]))
                yield pa.RecordBatch.from_arrays([pa.array(task + np.arange(part.num_rows)), part.column("doc_id"), part.column("held_out"), pa.array(codes, pa.binary()), lists], ["row", "doc_id", "held_out", "codes", "tail"])
                task += part.num_rows

    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = rows.mapInArrow(run, f"row long, doc_id {kind}, {_PACKED}, tail array<struct<word:string,times:int>>")
    part = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id", "codes"), F.lit(sizes.updates)).cast("int"))
    return cut(packed.withColumn("slice", part), "lm-packed", "slice")


def _head(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, ``most`` at the most, and their counts: those above a count that a histogram over count sizes (a few thousand rows) sets."""
    level = F.floor(64 * F.log2("c")).cast("int")
    room, least = most, 1 << 20
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    top = sorted(counts.where(level >= least).collect(), key=lambda r: (-r["c"], r["word"]))
    return [r["word"].encode() for r in top], np.array([r["c"] for r in top], np.float64)


def train(docs: DataFrame, sizes: Sizes = Sizes(), id_col: str = "doc_id", text_col: str = "text", rate: float = 0.3) -> tuple[Model, DataFrame]:
    """Learn from the documents that are not held out. Returns the model and the packed texts of all documents, for ``score``."""
    if sizes.buckets > 1 << 10:
        raise ValueError("there are 1,024 buckets at most")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    words = F.explode(F.array_append(split_words(ascii_lower(F.col("text")), SPACE), END)).alias("word")
    counts = cut(rows.where("not held_out").select(words).groupBy("word").agg(F.count("*").alias("c")), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head, head_counts = _head(counts, sizes.head)
    packed = _packed(rows, head, sizes)
    codes = packed.where("slice >= 0").select("codes")
    singles, n_buckets, n_signals, n_classes = sizes.singles, sizes.buckets, sizes.signals, sizes.classes
    head_bucket = np.array([bucket_of(w, n_buckets) for w in head], np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(n_buckets * n_signals, np.int64)
        for batch in batches:
            for skip, own, inside, _ in _codes(batch, 1 << 16):
                bucket = classes_of(own, head_bucket, np.arange(1 << 10))
                signal = np.where(own < n_signals, own.astype(np.int64), -1)
                for lag in _LAGS:
                    there = before(signal, inside, lag, -1)
                    use = (there >= 0) & ((own >= _TAIL) | (own >= singles))
                    use[:skip] = False
                    table += np.bincount(bucket[use] * n_signals + there[use], minlength=len(table))
        yield _blocks(table, sizes.blocks, "f8")

    found = _summed(codes.mapInArrow(near, "block int, task int, data binary"), "f8", codes.rdd.getNumPartitions())
    if not len(found):
        found = np.zeros(n_buckets * n_signals)
    bucket_class = cluster(found.reshape(n_buckets, n_signals), n_classes - singles) + singles
    head_class = np.where(np.arange(len(head)) < singles, np.arange(len(head)), bucket_class[head_bucket]) if head else np.zeros(0, np.int64)
    bucket_counts = counts.where(~F.col("word").isin([w.decode() for w in head[:singles]])).groupBy(bucket_column(F.col("word"), n_buckets).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # a row for each bucket
    class_tokens, class_words = np.zeros(n_classes), np.zeros(n_classes)
    class_tokens[: min(singles, len(head))] = head_counts[:singles]
    for r in bucket_counts:
        class_tokens[bucket_class[r["b"]]] += r["c"]
        class_words[bucket_class[r["b"]]] += r["v"]
    tree = Tree(sizes, head_class, head_counts, class_tokens + 0.5 * (class_words + 1))
    bias = np.log((class_tokens + 0.5) / (class_tokens.sum() + 0.5 * n_classes)).astype(np.float32)
    n_features = sizes.features(total["v"])
    climber, word_climber = Climber((n_features, n_classes)), Climber((n_features, sizes.outputs))
    n_tasks = max(2, total["n"] // sizes.updates // _TASK)  # a table from each: what is gathered grows with the texts
    for k in range(sizes.rounds * sizes.updates):
        shared = spark.sparkContext.broadcast((climber.weights, word_climber.weights))

        def slope(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, word_weights = shared.value
            total, words = np.zeros(weights.shape, np.float32), np.zeros(word_weights.shape, np.float32)
            for batch in batches:
                for skip, own, inside, _ in _codes(batch, sizes.batch):
                    kinds, own = [f[skip:] for f in features(own, inside, n_features)], own[skip:]
                    classes = classes_of(own, head_class, bucket_class)
                    total += gradient(weights, bias, kinds, classes)[1]
                    _, node, rows, output = tree.steps(own, classes, kinds, n_features)
                    if len(node):
                        words += gradient(word_weights, tree.bias[node], rows, output)[1]
            yield _blocks(np.concatenate([total.reshape(-1), words.reshape(-1)]), sizes.blocks, "f4")

        own = packed.where(F.col("slice") == k % sizes.updates).select("codes").coalesce(n_tasks)
        sums = _summed(own.mapInArrow(slope, "block int, task int, data binary"), "f4", n_tasks)
        if len(sums):
            for c, slope_of in zip((climber, word_climber), np.split(sums, [climber.weights.size]), strict=True):
                c.step(slope_of.reshape(c.weights.shape), rate / (1 + k // sizes.updates))
        shared.destroy()
    learned = climber.weights, bias, tree, word_climber.weights
    return Model(sizes, counts, total["n"], total["v"], head, head_counts, head_class, bucket_class, class_tokens, class_words, *learned), packed


def score(packed: DataFrame, model: Model) -> DataFrame:
    """One row per row of the documents behind ``packed``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark, sizes = packed.sparkSession, model.sizes
    shared = spark.sparkContext.broadcast((model.base_logs(), model.word_logs(), model.head_class, model.bucket_class, model.weights, model.bias, model.tree, model.word_weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, word, head_class, bucket_class, weights, bias, tree, word_weights = shared.value
        base, word = np.append(base, 0.0), np.append(word, 0.0)  # the last is for words that are not in the head
        for batch in batches:
            sums = np.zeros((4, batch.num_rows))
            for skip, own, inside, text in _codes(batch, sizes.batch):
                kinds = [f[skip:] for f in features(own, inside, len(weights))]
                own, text = own[skip:], text[skip:]
                place, classes = np.where(own >= _TAIL, len(head_class), own).astype(np.int64), classes_of(own, head_class, bucket_class)
                logs = log_class(weights, bias, kinds, classes) / np.log(10) + word[place]
                token, node, rows, output = tree.steps(own, classes, kinds, len(word_weights))
                if len(node):
                    logs += np.bincount(token, log_class(word_weights, tree.bias[node], rows, output), len(own)) / np.log(10)
                for row, values in enumerate((np.ones(len(own)), own < _TAIL, base[place], logs)):
                    sums[row] += np.bincount(text, values, batch.num_rows)
            whole = [pa.array(sums[i].astype(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *whole, pa.array(sums[2]), pa.array(sums[3])], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    scored = packed.select("row", "doc_id", "held_out", "codes").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double")
    c = F.coalesce("c", F.lit(0))
    room = model.tree.shared[model.bucket_class]  # of each bucket's class: words outside the head have no output of their own
    tail = packed.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(model.counts, "word", "left")
    added = tail.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known_too"),
        F.sum(F.col("times") * F.log10((c + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))).alias("base_too"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.get(F.array(*map(F.lit, map(float, room))), bucket_column(F.col("word"), sizes.buckets)))).alias("model_too"),
    )
    return scored.join(added, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_too", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_too", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("model_too", F.lit(0.0))).alias("score"),
    )
