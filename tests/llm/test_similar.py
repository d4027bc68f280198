"""Near-duplicate classes by Jaccard similarity against all pairs, and the pipeline's stage."""

import os
import random

import pytest

import brute
import corpus_pipeline
from conftest_data import DATA
from tallgrass.llm import similar, suffix


def edited(rng, words, share):
    return [f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def near_copies(n=60):
    rng, rows = random.Random(3), []
    for k in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(150, 600))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited(rng, words, 0.01 + 0.01 * (k % 3))))]
    return rows


def test_stage_finds_near_copies(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_kept(rows)
    assert len(want) < 90
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, DATA).collect()) == want


@pytest.mark.parametrize(("most_in_band", "most_in_block"), [(16, 200), (2, 200), (2, 3)])
def test_crowded_bands_give_the_same_classes(spark, monkeypatch, most_in_band, most_in_block):
    rng, rows = random.Random(9), []
    for k in range(3):  # a chain of edits and a star of edits: a leader is alike to a part of the class only
        words = [f"c{k}x{i}" for i in range(120)]
        for i in range(15):
            at = rng.randrange(120)
            words = [*words[:at], f"n{k}y{i}", *words[at + 1 :]]
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(edited(rng, [f"c{k}x{i}" for i in range(120)], 0.02))))
    real = similar.links
    monkeypatch.setattr(similar, "links", lambda d, p, s, least, t: real(d, p, s, least, t, most_in_band, most_in_block))
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == brute.near_kept(rows)


def test_odd_rows(odd, none):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(i, t) for i, t in [(r["doc_id"], r["text"]) for r in odd.collect()] if i is not None]
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == brute.near_kept(rows) and ids.count(None) == 1
    assert similar.keep_one(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("folder", [DATA, DATA.replace("sf0.001", "sf0.01")])
def test_stage_on_test_data(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, folder).collect()) == brute.near_kept(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_pipeline_keeps_what_all_pairs_keep(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = [(i, t) for i, t in rows if not brute.quality(t)[-1]]  # no host is bad in these tables
    text, ids = dict(rows), brute.near_kept(rows)
    texts = [w[2].decode(errors="ignore") for w in brute.removal([text[i] for i in ids], suffix.PASSAGE)]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = [i for i, c in zip(ids, brute.contamination(texts, items)) if not c[1]]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()) == want


def test_simhash_proposes_what_is_within_two_bits(spark):
    rng, rows = random.Random(4), []
    for k in range(12):  # copies with a few bits flipped, and equal fingerprints
        base = rng.randrange(1 << 63)
        flips = [0, 0, *(sum(1 << b for b in rng.sample(range(63), n)) for n in (1, 2, 2, 3, 9))]
        rows += [(100 * k + i, base ^ f) for i, f in enumerate(flips)]
    got = {tuple(r) for r in similar._proposed(spark.createDataFrame(rows, "node long, fp long")).collect()}
    heads = {}
    for node, fp in rows:
        heads[fp] = min(node, heads.get(fp, node))
    want = {(heads[fp], node) for node, fp in rows if heads[fp] != node}
    want |= {tuple(sorted((heads[a], heads[b]))) for a in heads for b in heads if a < b and (a ^ b).bit_count() <= 2}
    assert got == want and want
