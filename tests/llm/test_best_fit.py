"""Pieces whole and once, sequences gapless, few of them; plans against a plain best fit."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_packing import ODD
from tokenizers import Tokenizer

from peerlens.llm import best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")


def used(plan):
    """Checks every place; the number of sequences."""
    rows = []
    for s in np.flatnonzero(plan.counts).tolist():
        n = int(plan.counts[s])
        rows.append(np.stack([*plan.places(np.full(n, s), np.arange(n)), np.full(n, s)], 1))
    x = np.concatenate(rows)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    first = np.r_[True, x[1:, 0] != x[:-1, 0]]
    assert (x[first, 1] == 0).all() and (x[:, 1] + x[:, 2] <= plan.length).all()
    assert (x[1:, 1] == x[:-1, 1] + x[:-1, 2])[~first[1:]].all()
    assert first.sum() == plan.used
    return plan.used


def plain(sizes, length):
    """Best fit, in descending order."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(length - s)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_plan_places_everything(sizes):
    counts = np.bincount(sizes, minlength=65)
    groups = best_fit.Groups(counts, 64, groups=5)
    configured = best_fit.configurations(groups.sizes, groups.demand, 64)
    for share in (1.0, 0.5):
        assert used(best_fit.Plan(counts, 64, configured, groups, share)) >= -(-sum(sizes) // 64)


@pytest.mark.parametrize("kind", ["uniform", "thirds", "skewed"])
def test_few_sequences(kind):
    rng = np.random.default_rng(3)
    sizes = {"uniform": rng.integers(1, 1025, 3000), "thirds": rng.integers(250, 400, 3000), "skewed": np.clip(rng.lognormal(5, 1, 3000).astype(int), 1, 1024)}[kind]
    got, other = used(best_fit.best_plan(np.bincount(sizes, minlength=1025), 1024)), plain(sizes.tolist(), 1024)
    assert got <= other * 1.002
    if kind == "thirds":  # where configurations matter
        assert got < 0.97 * other


def test_one_length():
    counts = np.zeros(1025, np.int64)
    counts[400] = 1_000_001
    assert used(best_fit.best_plan(counts, 1024)) == 500_001


def test_configurations_are_optimal():
    """Sizes 6, 5 and 4 of 10: pairs of 6 and 4, pairs of 5."""
    out = best_fit.configurations([6, 5, 4], [7, 8, 7], 10)
    assert abs(sum(x for x, _ in out) - 11) < 1e-6


def test_pack(spark):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id"), (70, "word and more " * 900)]
    frame = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, length int, part string").repartition(3)
    rows = best_fit.pack(frame, PATH, length=64).collect()
    tokens = Tokenizer.from_file(PATH)
    per_doc, per_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        per_seq[r.sequence_id].append(r)
    total = 0
    for doc_id, text in docs:
        ids = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        times = sum(d[0] == doc_id for d in docs)
        n = -(-len(ids) // 64)
        assert sorted(r.piece for r in per_doc[doc_id]) == sorted(list(range(n)) * times)
        for r in per_doc[doc_id]:
            front = len(ids) - 64 * (n - 1)
            assert (r.start, r.length) == ((0, front) if not r.piece else (front + 64 * (r.piece - 1), 64))
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for pieces in per_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len(per_seq) <= -(-total // 64) + 2
    assert best_fit.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
