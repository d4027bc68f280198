"""Quality, decontamination, licences, SimHash and repeats against brute force, on odd rows and on test data."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from conftest_data import DATA, passage
from tallgrass.llm import decontaminate, license, quality, sharding, simhash, suffix
from tallgrass.llm.components import connected_components

#: Notices as public licences word them, none of them a template of the operator.
NOTICES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software"),
    ("MIT", "This project is released under the MIT license; see the file LICENSE."),
    ("MIT", "// SPDX-License-Identifier: MIT\n// Copyright 2019 the authors"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "The code is distributed under the terms of the Apache License 2.0, as is."),
    ("GPL", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("GPL", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
    ("LGPL", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer."),
    ("BSD", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at"),
    ("CC-BY", "Except where noted, this work is licensed under a Creative Commons Attribution 4.0 International License, and its text may be reused."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all\ncopyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software\nreleased into the public domain.\nAnyone is free to copy it."),
]
OTHERS = [
    "He lost his driving license and could not drive to work under the new rules of the city.",
    "Poetic license permits the author to distribute the blame over source and form.",
    "The foundation published a general report for the public, free of charge, to any person who asked.",
    "All rights reserved. No part of this book may be copied without permission of the publisher.",
    "The Apache helicopter, version 2, was released under pressure from the ministry.",
    "Students at MIT released a robot under the bridge; its software is subject to change.",
]

data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def multiset(rows):
    return Counter(repr(r) for r in rows)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality_on_odd_rows(odd, odd_rows):
    got = quality.judge(odd).collect()
    assert multiset((r[0], *r[2:8]) for r in got) == multiset((i, *brute.quality(t)) for i, t in odd_rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got if not (r["host_bad"] and r["soft_failed"]))


def test_quality_keeps_columns_and_clean_rows(odd, none, odd_rows):
    got = quality.keep_good(odd)
    assert got.columns == odd.columns
    assert multiset(r["doc_id"] for r in got.collect()) == multiset(i for i, t in odd_rows if not brute.quality(t)[-1])
    assert quality.keep_good(none).count() == 0 and quality.judge(none).count() == 0


def test_a_bad_host_loses_its_marked_documents_only(spark):
    clean, odd_text = passage(1, 80), passage(2, 60) + " ###### ****** %%%%%% "
    rows = [(i, odd_text if h == "bad" and i % 10 else clean, h) for h, n in (("bad", 200), ("good", 400)) for i in range(n)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    count = {(r["host"], r["soft_failed"], r["kept"]): r["count"] for r in got.groupBy("host", "soft_failed", "kept").count().collect()}
    assert count == {("bad", True, False): 180, ("bad", False, True): 20, ("good", False, True): 400}


ITEMS = [(1, "Two three FOUR five six seven, eight nine ten eleven"), (2, "x"), (3, None), (4, ""), (10, "one two"), (None, "one two three"), (5, passage(3, 25)), (6, passage(3, 25)), (5, "nowhere to be found in any of these texts at all")]


def test_contamination_on_odd_rows(spark, odd, odd_rows, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(odd, items).collect()
    want = brute.contamination([t for _, t in odd_rows], ITEMS)
    assert multiset((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got) == multiset((i, *w) for (i, _), w in zip(odd_rows, want))
    kept = decontaminate.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == sum(not w[1] for w in want)
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(odd, items.where("false")).where("contaminated").count() == 0


def test_contamination_without_broadcast_is_the_same(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = odd.select("doc_id", decontaminate.words(F.col("text")).alias("w"))
    a, b = (decontaminate.occurrences(rows, items, most_broadcast=n).collect() for n in (10**6, 0))
    assert multiset((r["doc_id"], r["start"], r["n"], sorted(r["item_ids"])) for r in a) == multiset((r["doc_id"], r["start"], r["n"], sorted(r["item_ids"])) for r in b)


@data
def test_contamination_on_test_data(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute.contamination([t for _, t in rows], [tuple(r) for r in bench.select("item_id", "text").collect()])
    got = decontaminate.contamination(docs, bench).collect()
    assert multiset((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got) == multiset((i, *w) for (i, _), w in zip(rows, want))


def test_licence_scan(spark, odd, none):
    lines = [passage(i, 40) + "\n" + passage(i + 50, 30) for i in range(60)]
    texts = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "We released the dogs under the bridge and talked about a license to drive."]
    rows = [(i, t) for i, t in enumerate(lines)] + [(100 + i, lines[i] + "\n" + t) for i, t in enumerate(texts)] + [(200, None), (201, "")]
    docs = spark.createDataFrame([*rows, rows[60]], "doc_id long, text string")
    model = license.fit(docs, most_unknown=200)
    got = {r["doc_id"]: r for r in license.scan(docs, *model).collect()}
    assert [got[100 + i]["license"] for i in range(5)] == ["MIT", "GPL", "CC-BY-NC", "Apache-2.0", None]
    assert all(got[i]["license"] is None and got[i]["n_paragraphs"] == 1 for i in range(60)) and got[200]["n_paragraphs"] == 0
    assert got[100]["n_licenses"] == 1 and license.scan(docs, *model).count() == len(rows) + 1
    assert {r["doc_id"] for r in license.scan(odd, *model).where("n_licenses > 0").collect()} == {14}
    assert license.scan(none, *model).count() == 0


def test_licence_recall_and_precision_on_notices_outside_the_templates(spark):
    rng, rows, want = random.Random(6), [], {}
    prose = [passage(500 + i, 150).split() for i in range(120)]
    cases = [*NOTICES, *((None, t) for t in OTHERS)]
    for i in range(3 * len(cases)):  # alone, within a paragraph, and far inside a long one
        family, text = cases[i // 3]
        lead, tail = [(0, 0), (rng.randrange(5, 30), rng.randrange(5, 30)), (140, 100)][i % 3]
        rows.append((1000 + i, " ".join(prose[rng.randrange(120)][:lead]) + "\n" + text + "\n" + " ".join(prose[rng.randrange(120)][:tail])))
        want[1000 + i] = family
    docs = spark.createDataFrame(rows + [(i, " ".join(w)) for i, w in enumerate(prose)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license.scan(docs, *license.fit(docs, most_unknown=300)).collect()}
    there = [i for i, f in want.items() if f]
    right = sum(got[i] == want[i] for i in there)
    print({i: (want[i], got[i]) for i in want if got[i] != want[i]})
    assert right >= 0.9 * len(there)
    assert right >= 0.95 * sum(v is not None for v in got.values())


def test_every_window_is_in_the_unknown_class(spark):
    """All windows but those with half of a template are fitted or kept for calibration, however few rows they weigh."""
    texts = [" ".join([passage(i, 200), passage(900 + i, 50)]) for i in range(90)] + ["Released under the MIT License. " + passage(990 + i, 20) for i in range(10)]
    texts += [passage(1200, 30) + " source code must retain", passage(1201, 30) + " the software license of this copyright"]  # marked words, no template
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = license._template_words(spark)
    rows = license.labelled(docs, "doc_id", "text", 20).where("label = 0")
    every = license.windows(docs, []).select("w", license._shingles("w", 3).alias("x"))
    want = every.where(F.greatest(*(license.shared_part(f, of) for f in license.TEMPLATES)) < 0.5).select("w")
    assert rows.count() == want.count() > 300 and want.count() <= every.count() - 10
    assert rows.select("w").exceptAll(want).count() == 0


def test_simhash_on_odd_rows(odd, odd_rows, none):
    prints = [brute.fingerprint(t) for _, t in odd_rows]
    root = brute.components(prints)
    best = {}
    for (i, _), p in zip(odd_rows, prints):
        if i is not None:
            best[root[p]] = min(best.get(root[p], i), i)
    got = simhash.near_duplicates(odd).collect()
    assert multiset((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == multiset((i, f"{p:016x}", best.get(root[p])) for (i, _), p in zip(odd_rows, prints))
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert multiset(r["doc_id"] for r in kept.collect()) == multiset([best.get(x) for x in set(root.values())])
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("most_in_bucket", [1, 2, 16])
def test_links_join_the_same_classes_in_any_bucket_size(spark, most_in_bucket):
    import random

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(40)} | {c ^ sum(1 << b for b in rng.sample(range(64), 3)) for c in centres}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 2, most_in_bucket)
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    root, mine = brute.components(prints), {}
    for p in prints:
        s = p - (1 << 64) if p >> 63 else p
        mine.setdefault(found.get(s, s), set()).add(p)
    want = {}
    for p, r in root.items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert connected_components(edges.where("false")).count() == 0


@pytest.mark.parametrize("most_in_group", [1, 4000])
def test_repeats_on_odd_rows(odd, odd_rows, most_in_group, monkeypatch):
    real = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda docs, length: real(docs, length, most_in_group))
    got = suffix.remove_repeats(odd, 400).collect()
    want = brute.removal([t for _, t in odd_rows])
    assert multiset((r["doc_id"], r["n_bytes"], [(x["first"], x["last"]) for x in r["spans"]], bytes(r["kept"])) for r in got) == multiset((i, *w) for (i, _), w in zip(odd_rows, want))


def test_repeats_cut_out_of_documents(odd, none, odd_rows):
    got = suffix.drop_repeats(odd, 400)
    assert got.columns == odd.columns
    want = [None if t is None else w[2].decode(errors="ignore") for (_, t), w in zip(odd_rows, brute.removal([t for _, t in odd_rows]))]
    assert multiset((r["doc_id"], r["text"]) for r in got.collect()) == multiset((i, t) for (i, _), t in zip(odd_rows, want))
    assert suffix.drop_repeats(none, 400).count() == 0 and suffix.remove_repeats(none, 400).count() == 0


@data
@pytest.mark.parametrize("most_in_group", [2, 4000])
def test_repeats_on_test_data(spark, most_in_group, monkeypatch):
    real = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda docs, length: real(docs, length, most_in_group))
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    got = suffix.remove_repeats(documents(spark), 400).collect()
    want = brute.removal([t for _, t in rows])
    assert multiset((r["doc_id"], [(x["first"], x["last"]) for x in r["spans"]]) for r in got) == multiset((i, w[1]) for (i, _), w in zip(rows, want))


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_passages_in_texts_cut_into_blocks(odd, odd_rows, block, monkeypatch):
    monkeypatch.setattr(suffix, "_BLOCK", block)  # most texts are then cut into several blocks
    got = suffix.remove_repeats(odd, suffix.PASSAGE).collect()
    want = brute.removal([t for _, t in odd_rows], suffix.PASSAGE)
    assert multiset((r["doc_id"], [(x["first"], x["last"]) for x in r["spans"]], bytes(r["kept"])) for r in got) == multiset((i, *w[1:]) for (i, _), w in zip(odd_rows, want))


def test_planted_passages_of_over_fifty_words_are_caught(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 4, 4, 5, 6, 7, 9]))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [some(rng.randrange(51, 61)) for _ in range(60)]
    planted = [(i, f"{some(80)} {passages[i % 60]} {some(60)}") for i in range(180)]
    clean = [(1000 + i, some(200)) for i in range(180)]
    got = {r["doc_id"]: r["text"] for r in suffix.drop_repeats(spark.createDataFrame(planted + clean, "doc_id long, text string"), suffix.PASSAGE).collect()}
    assert sum(passages[i % 60] not in got[i] for i, _ in planted) >= 0.9 * len(planted)
    assert all(got[i] == t for i, t in clean)


def test_cutting_repeats_leaves_other_columns_alone(spark):
    rows = [(i, "r" * 900 if i % 2 else f"own {i}", i, "x") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, `_tg_spans` string").withColumn("a.b", F.lit(1))
    got = suffix.drop_repeats(docs)
    assert got.columns == docs.columns
    assert multiset(map(tuple, got.collect())) == multiset((i, "" if i % 2 else t, k, s, 1) for i, t, k, s in rows)


def test_sharding_on_odd_rows(odd, odd_rows, none):
    got = sorted(sharding.assign_shards(odd, 5).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert multiset(r["doc_id"] for r in got) == multiset(i for i, _ in odd_rows)
    total, before = sum(r["size"] for r in got), 0
    ids = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert ids == sorted(ids) and total == sum(len((t or "").encode()) + 16 for _, t in odd_rows)
    for r in got:
        assert r["shard"] == min(4, (2 * before + r["size"]) * 5 // (2 * total))
        before += r["size"]
    for s in range(5):
        slots = [r["slot"] for r in got if r["shard"] == s]
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(none, 5).count() == 0


def test_written_shards_hold_every_row_once_in_order(spark, odd, tmp_path):
    sharding.write_shards(odd.withColumn("shard", F.lit("own")), f"{tmp_path}/shards", 5)
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert multiset(map(tuple, got.drop("_shard", "shard").collect())) == multiset(map(tuple, odd.collect())) and {r["shard"] for r in got.collect()} == {"own"}
    want = sharding.assign_shards(odd, 5).groupBy("shard").count().collect()
    assert {r["_shard"]: r["count"] for r in got.groupBy("_shard").count().collect()} == {r["shard"]: r["count"] for r in want}
