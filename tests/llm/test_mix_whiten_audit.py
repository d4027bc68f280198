"""Mixing, whitening and the audit of sources: brute force, NumPy's decompositions and exact counts."""

import os
import random
import re
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest_data import DATA, passage
from tallgrass.llm import divergence, mixing, queries, whitening

data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def shared(sizes, weights, most):
    """Targets by sharing again and again until no source is above its limit."""
    target, open_, rest = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_:
        each = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if each * weights[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else each * weights[s]
        rest -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return target


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, got, most=3):
    """rows: (doc_id, text, source); got: what sample() gave."""
    sizes, n = defaultdict(int), Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = shared(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, most)
    by = defaultdict(list)
    for i, text, source in rows:
        by[source].append((n_words(text), -1 if i is None else i))
    want = Counter()
    for s, docs in by.items():
        e = 0 if not sizes[s] else most << 30 if target[s] == most * sizes[s] else int(target[s] / sizes[s] * (1 << 30))
        at = int(md5(f"42:{s or ''}".encode()).hexdigest()[:8], 16) // 4
        for size, i in sorted(docs):
            copies = ((at + e) >> 30) - (at >> 30)
            want[i, size, sizes[s], copies, copies * size] += 1
            n[s] += copies * size
            at += e
        assert abs(n[s] - target[s]) <= max(size for size, _ in docs) * (1 if sizes[s] else 0)
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], r["copies"], r["taken"]) for r in got) == want
    assert all(0 <= r["copies"] <= most for r in got)


def test_mix_on_odd_rows(odd, none, odd_rows):
    rows = [(i, t, f"src{(i or 0) % 3}") for i, t in odd_rows]
    got = mixing.sample(odd).collect()
    check_mix(rows, got)
    assert mixing.sample(none).count() == 0
    assert sorted(map(repr, mixing.sample(odd.repartition(5)).collect())) == sorted(map(repr, got))  # reruns agree


def test_mix_with_a_hot_source_nulls_and_empty_sources(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 50, 2000 if i % 50 == 0 else 7])), rng.choice(["hot"] * 6 + ["é", "b", None, ""])) for i in range(600)]
    rows += [(1000, None, "empty"), (1001, " ", "empty"), (1002, "one", "tiny")]
    df = spark.createDataFrame([(i, t, s, 1, 2, 3, 4, 5) for i, t, s in rows], "doc_id long, text string, source string, copies int, part int, own int, size int, at int").repartition(7)
    got = mixing.sample(df).collect()
    check_mix(rows, got)
    assert {r["target"] for r in got if r["source_size"] == 1} == {3.0}  # the tiny source stops at three times its size
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert times == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_targets_when_all_but_one_are_full(spark):
    sizes = spark.createDataFrame([(False, "a", 1), (False, "b", 1), (False, "c", 1), (False, "d", 997)], "no_source boolean, source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got == {"a": 3.0, "b": 3.0, "c": 3.0, "d": 991.0}
    assert mixing.targets(sizes.where("false")).count() == 0


def whole_numbers(v):
    return np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000


def check_white(rows, got, full=None):
    """rows: (vec_id, vector) that can be used; got: rows of whiten()."""
    x = np.unique(np.array([whole_numbers(v) for _, v in rows]), axis=0)
    n, mean = len(x), x.mean(0)
    c = x - mean
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:16] > 1e-12 * values.sum()).sum())
    assert len(got) == len(rows) * k
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    want = defaultdict(list)
    for i, v in rows:
        want[i].append(whole_numbers(v))
    for j, part in by.items():
        sign = 0.0
        for r in part:
            at = want[r["vec_id"]][0]
            assert r["deviation"] in {sum((n * int(a) - int(b)) ** 2 for a, b in zip(at, x.sum(0))) for at in want[r["vec_id"]]}
            if len(want[r["vec_id"]]) == 1:
                w = float((at - mean) @ vectors[:, j - 1] / np.sqrt(values[j - 1]))
                sign = sign or (1.0 if w * r["whitened"] > 0 else -1.0)
                assert r["whitened"] * sign == pytest.approx(w, abs=1e-7)


SCHEMA = "vec_id long, embedding array<float>, x string, component int, row int, dim int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], "x", 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def test_whiten_expands_a_flat_spectrum(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 40)).astype(np.float32)
    rows = list(enumerate(v.tolist()))
    rows += [(1000 + i, v[7].tolist()) for i in range(80)] + [(None, v[0].tolist())]
    odd_ones = [(2000, None), (2001, []), (2002, [1.0] * 39), (2003, [None, *[1.0] * 39]), (2004, [float("nan")] * 40), (2005, [float("inf"), *[0.0] * 39]), (2006, [1e30] * 40)]
    df = frame(spark, rows + odd_ones)
    made, dim = whitening.fit(whitening.whole(df, "vec_id", "embedding"))
    assert made.full and dim == 40
    check_white(rows, whitening.whiten(df).collect())
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id >= 1000 and vec_id < 2000")).count() == 0  # one vector, many times
    assert whitening.whiten(df.where("vec_id = 2001")).count() == 0


def test_whiten_finds_a_steep_spectrum_without_the_full_dimension(spark):
    rng = np.random.default_rng(6)
    scale = np.r_[40.0 * 0.8 ** np.arange(20), np.zeros(44)]
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    rows = list(enumerate((np.floor(rng.standard_normal((400, 64)) * scale * 64) / 64 @ np.eye(64)).tolist()))
    df = frame(spark, rows)
    made, _ = whitening.fit(whitening.whole(df, "vec_id", "embedding"))
    assert not made.full and len(made.eigenvalues) == 16
    check_white(rows, whitening.whiten(df).collect())
    low = [(i, (np.array([a, b, 0, a + b]) @ turn[:4, :8]).tolist()) for i, (a, b) in enumerate(rng.standard_normal((50, 2)))]
    check_white(low, whitening.whiten(frame(spark, low)).collect())  # fewer dimensions than components


def test_deviations_beyond_a_long_are_null():
    x = np.array([[5, 7], [1 << 45, 3], [1 << 20, 1]])
    one = whitening.Whitener(1000, np.array([3, 3]), np.array([1, 2]), np.eye(2), np.ones(2), 1.0, 0.0, True)
    exact = [sum((1000 * (int(a) - 3) - r) ** 2 for a, r in zip(row, (1, 2))) for row in x]
    assert one.deviations(x) == [v if v < 1 << 63 else None for v in exact]


@data
def test_whitening_query(spark):
    got = queries.op11_whitening(spark, DATA).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_white(rows, got)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZbé日 1_\n🙂", max_size=12), max_size=8))
def test_slices_and_groups(texts):
    raw = [t.encode() for t in texts]
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    begins = np.cumsum([0, *map(len, raw)])[:-1]
    low, first, last = divergence.slices(buffer, begins)
    words = [low[a:b].tobytes().decode() for a, b in zip(first, last)]
    assert words == [w for t in texts for w in terms(t)]
    for digest in (divergence.xxhash.xxh3_64_intdigest, lambda b: len(b) % 2, lambda b: 7):  # hashes that collide, too
        if len(first):
            group, head = divergence.grouped(low, first, last, digest)
            assert [words[head[g]] for g in group] == words and len({words[h] for h in head[np.unique(group)]}) == len(set(words)) == len(np.unique(group))


def audited(rows, top):
    """rows: (lang, source, text)."""
    n, docs = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for lang, source, _ in rows}
    for lang, source, text in rows:
        n[lang or "", source or ""].update(terms(text))
        docs[lang or ""].update(set(terms(text)))
    out = Counter()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= 3]
        own = {s: {t: n[lang, s][t] for t in kept} for g, s in groups if g == lang}
        every = {t: sum(c[t] for c in own.values()) for t in kept}

        def p(counts):
            total = sum(counts.values()) + len(kept)
            return {t: 1 + 10**9 * (c + 1) // total for t, c in counts.items()}

        shares, all_ = {s: p(c) for s, c in own.items()}, p(every)
        for s, mine in shares.items():
            pairs = [(sum((mine[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in shares.items() if o != s]
            rare = [((mine[t] - all_[t]) ** 2 // all_[t], t) for t in kept if own[s][t] and mine[t] > all_[t]]
            for part, found, most in (("pair", pairs, 10**9), ("term", rare, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[lang, s, part, item, v, rank] += 1
    return out


def test_audit_on_odd_rows(odd, none, odd_rows):
    rows = [("en", f"src{(i or 0) % 3}", t) for i, t in odd_rows]
    got = Counter(map(tuple, divergence.audit(odd).collect()))
    assert got == audited(rows, 200) and got
    assert divergence.audit(none).count() == 0


def test_audit_by_blocks_chunks_and_pieces(spark):
    rng = random.Random(8)
    words = [f"{rng.choice('abcXYé日')}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    rows = []
    for i in range(120):
        lang, source = rng.choice(["en", "de", "de", "de", None, ""]), rng.choice(["hot"] * 5 + [None, "", "b", "ß", "quiet"])
        rows.append((lang, source, " ".join(rng.choices(words, weights=[1 / (1 + k) for k in range(150)], k=rng.choice([0, 3, 40, 900])))))
    rows += [("de", "long", "Wort" * 700 + " " + passage(3, 900)), ("fr", "lone", "rien"), ("fr", "other", None), ("de", "hot", None)]
    df = spark.createDataFrame([(*r, 1, "t", "x") for r in rows], "lang string, source string, text string, n int, term string, part string").repartition(4)
    want = audited(rows, 5)
    for block, chunk, piece in ((200_000, 256, 1 << 23), (40, 2, 256)):
        assert Counter(map(tuple, divergence.audit(df, top=5, block=block, chunk=chunk, piece=piece).collect())) == want


def test_shares_of_large_counts():
    n, total = np.array([0, 1, 10**15, 9 * 10**15], np.int64), np.array([9 * 10**15] * 4, np.int64)
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]


@data
@pytest.mark.parametrize("name", ["op12_mixing", "op13_divergence"])
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.queries()[name](spark, DATA)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(result.fetchall())


@data
def test_language_model_does_not_depend_on_partitions(spark):
    """The same texts in 2 and in 9 partitions, and a gain over the base on held-out texts."""
    from tallgrass.llm import lm

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scores = []
    for n in (2, 9):
        model, packed = lm.train(docs.repartition(n))
        scores.append({r["doc_id"]: (r["held_out"], r["base_score"], r["score"]) for r in lm.score(packed, model).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(abs(scores[1][i][2] - s) <= 1e-4 * max(1, abs(s)) for i, (_, _, s) in scores[0].items())
    assert sum(s - b for held, b, s in scores[0].values() if held) > 0
