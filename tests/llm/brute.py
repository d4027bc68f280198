"""What the operators have to give, by the plainest means."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def sha(b):
    return hashlib.sha256(b).hexdigest()


def quality(t):
    t = t or ""
    w = SPACE.findall(t)
    n = len(w)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    count = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {i + j for i in range(n - 2) if count[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def contamination(texts, items):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    out = []
    for t in texts:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for s in {len(x) for x in wins}:
            for k in range(len(w) - s + 1):
                if f := wins.get(tuple(w[k : k + s])):
                    hit |= set(range(k, k + s))
                    found |= f
        out.append((len(w), len(hit), sorted(found)))
    return out


def fingerprint(t, size=3):
    w = SPACE.findall(low(t))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, most=2):
    """{fingerprint: smallest fingerprint of its class}."""
    u = sorted(set(prints))
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in range(i):
            if (u[i] ^ u[j]).bit_count() <= most:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {x: u[find(i)] for i, x in enumerate(u)}


def removal(texts, size=400):
    """(n_bytes, spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                mark[i] += 1
                mark[i + size] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((len(b), [tuple(map(int, x)) for x in edge.reshape(-1, 2)], np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def shingle_sets(texts, size=5):
    words = [SPACE.findall(low(t)) for t in texts]
    return [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset() for w in words]


def near_kept(rows):
    """The smallest id of each class of (doc_id, text), five-word Jaccard similarity of 0.8 or more, by all pairs."""
    s, parent = shingle_sets([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) > 0:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best.setdefault(find(k), []).append(i)
    return sorted(min(x) for x in best.values())
