"""Removed bytes against brute force over all windows; suffix ranks and common prefixes against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from peerlens.llm import suffix_dedup as sd


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        body = (t or "").encode()
        seen.update(body[i : i + length] for i in range(len(body) - length + 1))
    out = []
    for d, t in rows:
        body = (t or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for i in range(len(body) - length + 1):
            if seen[body[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((repr(d), len(body), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    passages = [word(n) for n in (12, 25, 30, 60, 90)]
    rows = []
    for k in range(50):
        rows.append((k, "".join(rng.choice([word(rng.randrange(0, 40)), rng.choice(passages), rng.choice(passages)[3:]]) for _ in range(rng.randrange(0, 6)))))
    base = word(150)
    for k in range(60, 90):
        at = rng.randrange(150)
        rows.append((k, base[:at] + rng.choice("xyz") + base[at + 1 :]))
    return [*rows, (100, "ab" * 80), (101, "a" * 90), (102, None), (103, ""), (5, rows[5][1]), (104, base), (105, base), (None, base + "q")]


@pytest.mark.parametrize(("seed", "shard", "chunk"), [(1, 256, 1 << 20), (2, 3, 300), (3, 7, 1 << 20)])
def test_matches_brute_force(spark, monkeypatch, seed, shard, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sd.suffix_dedup(df, length=20, gram=4, shard=shard, with_kept=True).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 20)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_production_length(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(900)
    rows = [(1, word(500) + shared + word(30)), (2, shared[200:700] + word(5000)), (3, word(399) + shared[:399]), (4, word(3000)), (5, shared[10:409] + "!" + shared[410:820]), (6, shared)]
    got = sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 400)
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_and_prefixes():
    rng = np.random.default_rng(3)
    data = rng.integers(1, 3, 601).astype(np.uint8)
    data[300:500] = data[50:250]
    data[250] = 0
    starts, stops = np.array([0, 251]), np.array([250, 601])
    ends = np.repeat(stops, [251, 350])
    for some in (data, data[:1], data[:7], np.zeros(40, np.uint8)):
        assert sd.suffix_order(some).tolist() == sorted(range(len(some)), key=lambda i: bytes(some[i:]))
    order = sd.suffix_order(data)
    before = np.full(601, -1)
    before[order[1:]] = order[:-1]
    for most in (20, 1000):
        lcp = sd.kasai(data, starts, stops, before, ends, most)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < most and a + n < ends[a] and b + n < ends[b] and data[a + n] == data[b + n]:
                n += 1
            assert b == 250 or lcp[b] == n


def test_very_long_texts_and_other_columns(spark):
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(700))
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long[:200_000] + shared + long[200_000:], "x", 1), (2, shared, "y", 2), (3, "no " + shared[:399], None, None)]
    got = {r.doc_id: r for r in sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, body string, t1 int")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[1].n_bytes) == (700, 1, 400_700)
    assert (got[2].n_removed, got[3].n_removed) == (700, 0)
