"""Byte-pair encoding by backtracking over longest matches, and decoding with an offset table.

A word is a string of base symbols, the last of them marked as word end. An Aho-Corasick automaton over the reversed
vocabulary gives, in one pass over the reversed word, the longest token that begins at each place. The encoder takes
the longest token, checks it against the token before it with the pair-compatibility rule (would the merges, in their
order, have joined anything across that seam?), falls back to the next shorter prefix, and steps back where none fits;
places found dead are not tried again, so the work is linear. The result is exactly what applying the merges gives.

Decoding looks tokens up in one byte string with an offset table and joins them with blanks, as the vocabulary's files
ask for (no decoder of their own).

Words repeat, so each task keeps the words it met last with their ids, in two generations of bounded size.

Defined cases: a null text is an empty one and has no ids; strings of the added tokens in a text are those tokens; a
null id, repeated rows and an empty table go through row by row; a very long text is encoded whole, a word at a time; there are no ties; other columns are
ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

_WORD_END = "</w>"
#: Added to a symbol's code point to mark it as a word's last.
_LAST = 0x10000
#: Words that one generation of the memory holds, and the longest word that is kept.
_KEPT, _LONGEST = 200_000, 64


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stays, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Memory(dict):
    """word -> make(word), for the words met last."""

    def __init__(self, make):
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, word):
        found = self._old.get(word)
        if found is None:
            found = self._make(word)
            if len(word) > _LONGEST:
                return found
        if len(self) >= _KEPT:
            self._old = dict(self)
            self.clear()
        self[word] = found
        return found


class Splitter:
    """The words of a text, as the vocabulary file's normalizer and splitting pattern give them. Whether a character is a letter depends on the
    version of Unicode: a text with characters that Python's tables have not is left to the tokenizers library's own splitter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel":
            raise ValueError("this kind of vocabulary file is not supported")
        self._words = regex.compile(split["pattern"]["Regex"]).findall
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        marks = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self._marks = regex.compile(f"({'|'.join(marks)})") if marks else None
        self._library = Tokenizer.from_file(path)
        self._bytes = {ord(s): b for b, s in enumerate(byte_symbols())}

    def plain(self, text: str) -> list[str]:
        """The words of a text without added tokens. White space only separates words, so it need not be made even first."""
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                split = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
                return [bytes(self._bytes[ord(c)] for c in w).decode(errors="surrogateescape") for w, _ in split]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is no case of its own
        return self._words(text.lower())

    def __call__(self, text: str) -> list[str]:
        if self._marks is None or "<" not in text or not self._marks.search(text):
            return self.plain(text)
        return [w for i, part in enumerate(self._marks.split(text)) for w in ([part] if i % 2 else self.plain(part))]


class Vocabulary:
    """A byte-pair vocabulary with a word end. Tokens are numbered in the order of their merges, base symbols first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != _WORD_END or model["ignore_merges"] or model["byte_fallback"] or model["continuing_subword_prefix"]:
            raise ValueError("this kind of vocabulary file is not supported")
        self.words = Splitter(path)
        ids, self._symbols = model["vocab"], byte_symbols()
        units, number = [], {}  # number: of a token's text in the file
        for end in ("", _WORD_END):
            for s in self._symbols:
                number[s + end] = len(units)
                units.append(chr(ord(s) + _LAST) if end else s)
        self._n_base = len(units)
        self._halves, self._merged = [(i, i) for i in range(self._n_base)], {}
        for a, b in model["merges"]:
            pair = number[a], number[b]
            number[a + b] = self._merged[pair] = len(units)
            units.append(units[pair[0]] + units[pair[1]])
            self._halves.append(pair)
        if len(number) != len(units):
            raise ValueError("two merges make the same token")
        self._ids = [ids[t] for t in number]
        self._length = [len(u) for u in units]
        at = {u: i for i, u in enumerate(units)}
        self._shorter = [next((at[u[:n]] for n in range(len(u) - 1, 0, -1) if u[:n] in at), None) for u in units]
        self._ends = ahocorasick.Automaton()
        for i, u in enumerate(units):
            self._ends.add_word(u[::-1], i)
        self._ends.make_automaton()
        self._bytes = {b: s for b, s in enumerate(self._symbols)}
        self.memory = Memory(lambda w: np.array(self.encode_word(w), "<u4").tobytes())
        texts = dict.fromkeys(range(max(max(ids.values()), *self.words.added.values(), 0) + 1), b"")
        texts |= {i: t.encode() + b" " for t, i in [*ids.items(), *self.words.added.items()]}
        self._blob = np.frombuffer(b"".join(texts[i] for i in range(len(texts))), np.uint8)
        self._offsets = np.cumsum([0, *(len(texts[i]) for i in range(len(texts)))])

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side. The merges of both are undone, the latest first; at each point a merge
        across the seam that comes before the one last undone would have been made instead."""
        before = len(self._halves)
        while True:
            across = self._merged.get((left, right))
            if across is not None and across < before:
                return False
            if left > right and left >= self._n_base:
                before, left = left, self._halves[left][1]
            elif right >= self._n_base:
                before, right = right + 1, self._halves[right][0]  # of equal merges the leftmost comes first
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word (or of one added token)."""
        if word in self.words.added:
            return [self.words.added[word]]
        symbols = word.encode().decode("latin-1").translate(self._bytes)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _LAST)
        n, length, shorter = len(symbols), self._length, self._shorter
        longest: list[int] = [-1] * n
        for end, token in self._ends.iter(symbols[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or length[token] > length[longest[at]]:
                longest[at] = token
        alive, out, at = [True] * (n + 1), [], 0
        token: int | None = longest[0]
        while at < n:
            while token is not None and not (alive[at + length[token]] and (not out or self.compatible(out[-1], token))):
                token = shorter[token]
            if token is None:  # nothing fits here: give up this place and shorten the token before
                alive[at] = False
                token = out.pop()
                at -= length[token]
            else:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else None
        return [self._ids[t] for t in out]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.words(text or ""))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens, in UTF-8, joined with blanks."""
        if not len(ids):
            return b""
        begin = self._offsets[ids]
        size = self._offsets[ids + 1] - begin
        place = np.cumsum(size)
        take = np.arange(place[-1]) + np.repeat(begin - (place - size), size)
        return self._blob[take].tobytes()[:-1]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once in a worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), decoded (the text of the ids). ``path`` is the vocabulary
    file, there on every executor."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [vocab.encode(x) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids).astype(np.int32))
                decoded = pa.array([vocab.decode(x) for x in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")
