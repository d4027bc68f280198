"""Numbered lines by ranges against Python's own."""

import gzip
import random

import pytest

from tallgrass.sources import lines


@pytest.mark.parametrize("piece, stretch", [(lines.PIECE, lines.RANGE), (7, 11), (1, 1), (64, 5)])
def test_lines_by_ranges(spark, tmp_path, piece, stretch):
    rng = random.Random(piece)
    texts = {
        "a.txt": "\n".join("é" * rng.choice([0, 1, 3, 9]) + str(k) for k in range(40)),
        "b.txt": "one\r\ntwo\n\n\nfive\n",
        "c.txt": "",
        "d.txt": "\n",
        "e.txt": "no end",
        "f.data": "packed\nwithout a telling name\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name == "f.data" else text.encode())
    got = {}
    for r in lines.read_lines(spark, f"file://{tmp_path}", piece, stretch).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["at"], r["line"]))
    for name, text in texts.items():
        want = [x.rstrip("\r") for x in text.split("\n")]
        want = want[:-1] if want[-1] == "" else want
        assert sorted(got.get(name, [])) == list(enumerate(want)), name
