"""Tokenizers, token files, archives, the language model and the pipeline: exact round trips and brute force."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from conftest_data import DATA, passage
from tallgrass.llm import bpe, lm, queries, suffix, tokenfile, warc
from tallgrass.llm.induced import common_prefixes, suffix_array

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCAB = bpe.Vocabulary(PATH)
data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abeinorst' é.,!0İΣσςİßﬁ \u0085​ \x1c", max_size=60)))
def test_encode_and_decode_like_the_library(text):
    ids = VOCAB.encode(text)
    assert ids.tolist() == library_ids(text)
    assert VOCAB.decode(ids).decode() == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_encode_long_and_odd_words():
    rng = random.Random(1)
    for text in ["a" * 5000, "".join(rng.choice("abcdefgh") for _ in range(5000)), "<|endoftext|>a<|startoftext|>", "ab<|endoftext|", "x" * 70 + " " + "y" * 70]:
        assert VOCAB.encode(text).tolist() == library_ids(text)


def test_round_trip_frame(odd, none, odd_rows):
    got = bpe.round_trip(odd, PATH).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(library_ids(t))) for i, t in odd_rows)
    assert all(r["decoded"] == LIBRARY.decode(r["ids"], skip_special_tokens=False) for r in got)
    assert bpe.round_trip(none, PATH).count() == 0


def test_token_files(spark, odd, none, odd_rows):
    files = tokenfile.write_tokens(odd, PATH, 1, 49408, length=16, rows=2)
    got = sorted(tokenfile.read_documents(files).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, np.array([*library_ids(t), 1], "<u4").tobytes()) for i, t in odd_rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(len(r["ids"]) // 4 for r in got)])[:-1].tolist()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    # every sequence has the same length; the mask ends with the file's tokens
    for r in files.collect():
        file = tokenfile.TokenFile(r["uri"])
        n = -(-r["n_tokens"] // 16)
        parts = [file.sequence(i) for i in range(n)]
        assert all(len(ids) == 16 and len(mask) == 16 and ids.dtype == np.uint16 for ids, mask in parts)
        assert sum(sum(mask.to_pylist()) for _, mask in parts) == r["n_tokens"]
        assert np.concatenate([ids for ids, _ in parts])[: r["n_tokens"]].tolist() == file.span(0, r["n_tokens"]).tolist()
        base = pa.memory_map(r["uri"].removeprefix("file://"))
        assert parts[0][0].base is not None and base.size() > 0
    assert tokenfile.read_documents(tokenfile.write_tokens(none, PATH, 1, 49408)).count() == 0


PAGES = [(1, "http://a/\r\nX: 1", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 49), (7, "u", "é" * 50), (9, "u", "é" * 50), (8, "u", "WARC/1.1\r\n\r\n\x1f" * 30), (None, "u", "<p>" + "x" * 200)]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    pages = spark.createDataFrame([(*p, 7) for p in [*PAGES, PAGES[0]]], "page_id long, url string, html string, digest int")
    read = warc.read_warc(warc.write_warc(warc.plan_records(pages), compress=compress)).collect()
    assert len(read) == 11 and all(r["reason"] is None for r in read)
    by = {}
    for r in read:
        by.setdefault(r["record_id"], []).append(r)
    for page, url, html in PAGES:
        for r in by[f"urn:page:{'' if page is None else page}"]:
            payload = (html or "").encode()
            assert r["digest"] == hashlib.sha256(payload).hexdigest() and r["payload_length"] == len(payload)
            assert r["kind"] == ("revisit" if page in (2, 9) else "response")
            assert bytes(r["payload"]) == (b"" if page in (2, 9) else payload)
            assert r["refers_to"] == {2: "urn:page:1", 9: "urn:page:7"}.get(page)
            assert r["target_uri"] == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
    assert len(by["urn:page:1"]) == 2
    assert warc.read_warc(warc.write_warc(warc.plan_records(pages.where("false")))).count() == 0


def archive(n: int, compress: bool) -> tuple[bytes, list[tuple[int, int]]]:
    out, places = b"", []
    for i in range(n):
        payload = f"<p>{passage(i, 30 + i)}".encode()
        raw = warc.record_bytes("response", f"urn:page:{i}", "u", payload, hashlib.sha256(payload).hexdigest(), None, "2000-01-01T00:00:00Z")
        raw = gzip.compress(raw, 3, mtime=0) if compress else raw
        places.append((len(out), len(out) + len(raw)))
        out += raw
    return out, places


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_all_but_the_damaged(compress):
    clean, places = archive(12, compress)
    rng = random.Random(3)
    for kind in ("flip", "cut", "junk", "zero", "end"):
        for k in range(12):
            a, b = places[k]
            raw = bytearray(clean)
            if kind == "flip":
                raw[(a + b) // 2] ^= 0x55
            elif kind == "cut":
                del raw[(a + b) // 2 : b]
            elif kind == "junk":
                raw[a:a] = bytes(rng.randrange(256) for _ in range(500)) + b"\x1f\x8b\x08" + b"WARC/1."
            elif kind == "zero":
                raw[a : a + 20] = bytes(20)
            else:
                del raw[(places[-1][0] + places[-1][1]) // 2 :]
            got = list(warc.salvage(io.BytesIO(bytes(raw))))
            names = [h["warc-record-id"] for _, _, reason, h, _ in got if reason is None]
            lost = set() if kind == "junk" else {11} if kind == "end" else {k}
            assert {f"<urn:page:{i}>" for i in range(12) if i not in lost} <= set(names), (kind, k)
            if not (kind == "flip" and len(names) == 12):  # a flipped bit in a gzip header's free fields does no harm
                assert any(reason for _, _, reason, _, _ in got), (kind, k)
            edges = [x for begin, end, *_ in got for x in (begin, end)]
            assert edges[0] == 0 and edges[-1] == len(raw) and edges[1:-1:2] == edges[2::2]  # records and gaps cover the file


def records(n: int, url: str = "u") -> list[bytes]:
    return [warc.record_bytes("response", f"urn:page:{i}", url, b"<p>%d" % i * 40, "0", None, "2000-01-01T00:00:00Z") for i in range(n)]


@pytest.mark.parametrize("bad", [None, 0, 3, 5])
def test_salvage_looks_inside_a_member_of_many_records(bad):
    rows = records(6)
    if bad is not None:
        rows[bad] = rows[bad].replace(b"<p>", b"<q>", 1)
    member, after = gzip.compress(b"".join(rows), mtime=0), gzip.compress(records(1, "after")[0], mtime=0)
    got = list(warc.salvage(io.BytesIO(member + after)))
    assert [h["warc-record-id"] for _, _, reason, h, _ in got if reason is None] == [f"<urn:page:{i}>" for i in range(6) if i != bad] + ["<urn:page:0>"]
    assert got[-1][3]["warc-target-uri"] == "after" and {x[:2] for x in got[:-1]} == {(0, len(member))}
    gaps = [reason for _, _, reason, _, _ in got if reason]
    first = sum(map(len, rows[: bad or 0]))
    assert gaps == ([] if bad is None else [f"digest check failed: bytes {first} to {first + len(rows[bad])} of the member's content"])


def test_other_digests_and_long_headers():
    raw = records(1)[0]
    block = raw.split(b"\r\n\r\n", 1)[1][:-4]
    ours = b"sha256:" + hashlib.sha256(block).hexdigest().encode()
    sha1 = hashlib.sha1(block).digest()
    for said in (b"sha1:" + base64.b32encode(sha1), b"SHA1:" + sha1.hex().encode(), b"other:x"):
        good = raw.replace(ours, said)
        assert [x[2] for x in warc.salvage(io.BytesIO(good))] == [None]
        assert [x[2] for x in warc.salvage(io.BytesIO(good.replace(b"<p>", b"<q>", 1)))] == [None if said == b"other:x" else "digest check failed"]
    for data in (long := records(3, "u" * (3 << 20))), [gzip.compress(x) for x in long]:
        assert [x[2] for x in warc.salvage(io.BytesIO(b"".join(data)))] == [None] * 3
    assert [x[2] for x in warc.salvage(io.BytesIO(gzip.compress(b"")))] == ["the member is empty"]


def test_lm_base_scores_and_probabilities(spark, odd, odd_rows, none):
    sizes = lm.Sizes(most_features=64, classes=8, singles=4, buckets=32, signals=8, head=6, rounds=2, batch=50, blocks=4)
    model, packed = lm.train(odd, sizes)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in odd_rows]
    words = [[*brute.SPACE.findall(brute.low(t)), lm.END] for _, t in odd_rows]
    c = Counter(w for x, h in zip(words, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score(packed, model).collect())
    want = Counter((i, h, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)) for (i, _), h, x in zip(odd_rows, held, words))
    assert got == want
    # a class's words and its unseen slot have probabilities that add up to one
    of = {w: int(model.bucket_class[lm.bucket_of(w.encode(), sizes.buckets)]) for w in c}
    rest = [w for w in c if w.encode() not in model.head[: sizes.singles]]
    for k in range(sizes.singles, sizes.classes):
        own = [w for w in rest if of[w] == k]
        room = model.class_tokens[k] + 0.5 * (model.class_words[k] + 1)
        assert len(own) == model.class_words[k] and sum(c[w] + 0.5 for w in own) + 0.5 == pytest.approx(room)
    assert lm.score(*lm.train(none, sizes)[::-1]).count() == 0
    # the score itself, token by token
    place = {w.decode(): i for i, w in enumerate(model.head)}

    def code(w):
        return place[w] if w in place else 1 << 31 | lm.bucket_of(w.encode(), sizes.buckets) << 21 | zlib.crc32(w.encode()) & (1 << 21) - 1

    def log_probability(text):
        total, past = 0.0, [0, 0, 0]
        for w in text:
            a, b, d = past
            rows = [((x + 1) * int(m) % 2**64 >> 40) % len(model.weights) for x, m in zip([a, b, d, (a * 31 + (b << 24)) % 2**64, (a * 37 + (d << 25)) % 2**64], lm._MULTIPLIERS)]
            logits = [float(model.bias[k]) + sum(float(model.weights[r, k]) for r in rows) for k in range(sizes.classes)]
            own = place[w] if place.get(w, 99) < sizes.singles else int(model.bucket_class[lm.bucket_of(w.encode(), sizes.buckets)])
            total += (logits[own] - math.log(sum(map(math.exp, logits)))) / math.log(10)
            if own >= sizes.singles:
                total += math.log10((c[w] + 0.5) / (model.class_tokens[own] + 0.5 * (model.class_words[own] + 1)))
            past = [code(w) + 1, a, b]
        return total

    got = Counter((r["doc_id"], round(r["score"], 2)) for r in lm.score(packed, model).collect())
    assert np.abs(model.weights).max() > 0
    assert got == Counter((i, round(log_probability(x), 2)) for (i, _), x in zip(odd_rows, words))


def test_lm_word_factor_is_a_softmax_over_features(spark, odd, odd_rows):
    """Words with outputs of their own, words in groups and words below the count, token by token; after any words, all probabilities add up to one."""
    sizes = lm.Sizes(most_features=64, classes=6, singles=2, buckets=8, signals=4, head=1000, rounds=2, batch=50, blocks=4, outputs=8, least=4)
    copies = [(100 + k, passage(5, 400)) for k in range(10)]
    texts, more = [*odd_rows, *copies], spark.createDataFrame(copies, "doc_id long, text string")
    model, packed = lm.train(odd.select("doc_id", "text").union(more), sizes)
    words = [[*brute.SPACE.findall(brute.low(t)), lm.END] for _, t in texts]
    c = Counter(w for (i, _), x in zip(texts, words) if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in x)
    place = {w.decode(): i for i, w in enumerate(model.head)}
    of = {w: place[w] if place.get(w, 99) < sizes.singles else int(model.bucket_class[lm.bucket_of(w.encode(), sizes.buckets)]) for w in {*c, *(w for x in words for w in x)}}
    paths = {}  # word -> (output, number of its group or None, output there)
    for k in range(sizes.singles, sizes.classes):
        own = [w for w in sorted(place, key=place.get) if of[w] == k and place[w] >= sizes.singles and c[w] >= sizes.least][:28]
        paths |= {w: (i + 1, None, None) if i < 4 else (5 + (i - 4) // 8, (i - 4) // 8, (i - 4) % 8) for i, w in enumerate(own)}
    assert {p[1] for p in paths.values()} >= {None, 0, 1} and len(paths) < len(place) < len(c)
    size = np.zeros((sizes.classes, 8)), np.zeros((sizes.classes, 3, 8))
    for w in c:
        out, group, second = paths.get(w, (0, None, None))
        size[0][of[w], out] += c[w] + 0.5
        if group is not None:
            size[1][of[w], group, second] += c[w] + 0.5
    size[0][:, 0] += 0.5  # the unseen slot

    def number(w):
        return place[w] if w in place else 1 << 31 | lm.bucket_of(w.encode(), sizes.buckets) << 21 | zlib.crc32(w.encode()) & (1 << 21) - 1

    def chosen(rows, node, shares, out):
        rows = [(r ^ (node + 1) * 0x9E3779B1 >> 8) % len(model.word_weights) for r in rows]
        e = [share * math.exp(sum(float(model.word_weights[r, j]) for r in rows)) for j, share in enumerate(shares)]
        return e[out] / sum(e)

    def probability(w, past):
        a, b, d = past
        rows = [((x + 1) * int(m) % 2**64 >> 40) % len(model.weights) for x, m in zip([a, b, d, (a * 31 + (b << 24)) % 2**64, (a * 37 + (d << 25)) % 2**64], lm._MULTIPLIERS)]
        e = [math.exp(float(model.bias[k]) + sum(float(model.weights[r, k]) for r in rows)) for k in range(sizes.classes)]
        k = of[w] if w in of else int(w)  # a number is the unseen slot of a class
        p = e[k] / sum(e)
        if k < sizes.singles:
            return p
        out, group, second = paths.get(w, (0, None, None))
        p *= chosen([rows[0], rows[3]], k, size[0][k], out)
        if out == 0:
            return p * (c[w] + 0.5) / size[0][k, 0]
        return p if group is None else p * chosen([rows[0], rows[3]], sizes.classes + 3 * k + group, size[1][k, group], second)

    def log_probability(text):
        total, past = 0.0, [0, 0, 0]
        for w in text:
            total += math.log10(probability(w, past))
            past = [number(w) + 1, *past[:2]]
        return total

    got = {r["doc_id"]: r["score"] for r in lm.score(packed, model).where("doc_id is not null").collect()}
    for (i, _), x in zip(texts[:-9], words):
        assert i is None or got[i] == pytest.approx(log_probability(x), rel=1e-4, abs=1e-3)
    assert np.abs(model.word_weights).max() > 0.1
    for past in ([0, 0, 0], [number(words[12][7]) + 1, number(words[12][6]) + 1, number(words[12][5]) + 1]):
        assert sum(probability(w, past) for w in [*c, *map(str, range(sizes.singles, sizes.classes))]) == pytest.approx(1, abs=1e-6)


def test_lm_gradient_is_the_slope_of_the_log_likelihood():
    rng = np.random.default_rng(4)
    weights, bias = rng.normal(size=(64, 5)), rng.normal(size=5)
    kinds, classes = [rng.integers(0, 64, 40) for _ in range(3)], rng.integers(0, 5, 40)
    times, slope = lm.gradient(weights, bias, kinds, classes)
    assert times.sum() == 120
    for f, k in [(int(kinds[0][0]), 0), (int(kinds[1][3]), 2), (int(kinds[2][7]), 4)]:
        up, down = weights.copy(), weights.copy()
        up[f, k] += 1e-5
        down[f, k] -= 1e-5
        change = (lm.log_class(up, bias, kinds, classes).sum() - lm.log_class(down, bias, kinds, classes).sum()) / 2e-5
        assert slope[f, k] == pytest.approx(change, abs=1e-5)


def test_lm_tables_are_summed_in_levels(spark):
    tables = spark.createDataFrame([(b, t, np.full(3, t + b, "f8").tobytes()) for b in (0, 1) for t in range(70)], "block int, task int, data binary")
    assert lm._summed(tables, "f8", 70).tolist() == [2415.0] * 3 + [2485.0] * 3


@data
def test_lm_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model, packed = lm.train(docs)
    row = lm.score(packed, model).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert row["s"] > row["b"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_and_common_prefixes(symbols):
    text = np.array([*symbols, 0], np.int32)
    sa = suffix_array(text, 5)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    shared = common_prefixes(text, sa, np.arange(len(text) - 1, -1, -1))
    for a, b in zip(sa[1:], sa):
        n = 0
        while max(a, b) + n < len(symbols) and text[a + n] == text[b + n]:
            n += 1
        assert shared[a] == n


@data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    theirs = Counter(tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall())
    assert Counter(tuple(r[c] for c in sorted(names)) for r in got.collect()) == theirs


@data
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = {i: t for i, t in rows.items() if not brute.quality(t)[-1]}  # no host is bad in these tables
    ids = brute.near_kept(list(rows.items()))
    texts = [w[2].decode(errors="ignore") for w in brute.removal([rows[i] for i in ids], suffix.PASSAGE)]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i: tuple(library_ids(t)) for i, t, c in zip(ids, texts, brute.contamination(texts, items)) if not c[1]}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"]: tuple(r["ids"]) for r in got} == want and len(got) == len(want)


def test_pipeline_on_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    hot = [(100 + i, "$ # % " * 20 + passage(50 + i, 60), "en", "bad", 0, 0, "", "", 0) for i in range(6)]  # a host whose documents nearly all fail a rule
    hot += [(200, passage(99, 80), "en", "bad", 0, 0, "", "", 0), (200, passage(99, 80), "en", "bad", 0, 0, "", "", 0)]
    docs = odd.union(spark.createDataFrame(hot, odd.schema)).withColumn("source", F.when(F.col("source") == "bad", "bad").otherwise(F.lit(None).cast("string")))
    for name, table in (("odd", docs), ("none", none)):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (2, ""), (3, passage(3, 20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, folder)
            assert kept.columns == table.columns
        got = corpus_pipeline.run(spark, folder)
        assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
        ids = [r["doc_id"] for r in got.collect()]
        assert len(ids) == len(set(ids)) if name == "odd" else not ids
        if name == "odd":
            assert 200 in ids and not {100, 101, 102, 103, 104, 105} & set(ids)  # the host rule rejects marked documents of a bad host, and keeps its clean one, once
