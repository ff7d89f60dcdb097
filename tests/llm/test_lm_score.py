"""The lattice against all segmentations, and the whole score against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from peerlens.llm import lm_score as lm

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string"


def by_hand(lattice, word):
    """All segmentations, one by one."""
    known = dict(zip(lattice.pieces, lattice.logp, strict=True))
    word = b" " + word

    def below(at):
        if at == len(word):
            return [0.0]
        return [known[word[at:e]] + rest for e in range(at + 1, len(word) + 1) if word[at:e] in known for rest in below(e)]

    paths = below(0)
    return math.log(math.fsum(math.exp(p) for p in paths)) + lattice.stop, paths


def test_forward_and_expected_counts():
    lattice = lm.Lattice.start(PATH)
    words = [b"the", b"a", b"thingham", "naïve".encode(), b"qqqq", b"0"]
    got = lattice.score(words)
    for word, value in zip(words, got, strict=True):
        assert value == pytest.approx(by_hand(lattice, word)[0], rel=1e-9)
    small = lm.Lattice([bytes([b]) for b in range(256)] + [b"ab", b" a", b"bb"], np.log(np.full(259, 0.9 / 259)), math.log(0.1))
    counts, n = small.expected([b"abb", b"ba"])
    assert n == 2
    total = sum(counts[k] * len(p) for k, p in enumerate(small.pieces))
    assert total == pytest.approx(len(b" abb") + len(b" ba"))
    assert np.isfinite(lattice.score([b"x" * 5000])).all()
    fitted = small.fitted(counts, n)
    assert np.exp(fitted.logp).sum() + math.exp(fitted.stop) == pytest.approx(1)


def make(n=80):
    rng = random.Random(2)
    vocab = ["The", "the", "thing", "of", "Ünder", "x1", "zq", "and,"]
    docs = [(k, " ".join(rng.choice(vocab) if rng.random() < 0.9 else f"new{rng.randrange(99)}" for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None])) for k in range(n)]
    return docs + [(500, None, "en"), (501, "", None), (502, "\x0b \n", "en"), (None, "the thing", "en"), (3, docs[3][1], docs[3][2]), (503, "y" * 900, "fr")]


@pytest.mark.parametrize("hot", [3, 1000])
def test_score_matches_plain_python(spark, hot):
    docs = make()
    got = lm.lm_score(spark.createDataFrame(docs, DOCS), PATH, hot=hot, rounds=1).collect()
    assert len(got) == len(docs)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    tokens = lambda t: [w for w in (t or "").encode().lower().split()]
    counts = Counter(w for i, t, _ in docs if not held(i) for w in tokens(t))
    ends = sum(not held(i) for i, _, _ in docs)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    by_id = {}
    for i, t, _ in docs:
        by_id.setdefault(i, []).append(t)
    for r in got:
        words = tokens(by_id[r.doc_id][0])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(words) + 1, n)
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert -1e5 < r.score < 0
    # The whole model by hand.
    lattice = lm.Lattice.start(PATH)
    types = sorted(counts)
    lattice = lattice.fitted(*lattice.expected(types))
    kinds = Counter(x or "" for i, _, x in docs if not held(i))
    top = sorted(kinds, key=lambda x: (-kinds[x], x))[: lm.CLASSES - 1]
    sets = [[d for d in docs if not held(d[0]) and (d[2] or "") == x] for x in top] + [[]]
    assert sum(map(len, sets)) == ends
    d = lm.DISCOUNT
    for r in got[::7]:
        words, logs = tokens(by_id[r.doc_id][0]), []
        for own in sets:
            c = Counter(w for x in own for w in tokens(x[1]))
            nk, vk = sum(c.values()) + len(own), len(c) + bool(own)
            total = math.log10((len(own) + 0.5) / (ends + 0.5 * len(sets)))
            for w in [*words, None]:
                p = max((counts[w] if w is not None else ends) - d, 0) / n + (d * v / n * math.exp(lattice.score([w])[0]) if w is not None else 0)
                total += math.log10(max((c[w] if w is not None else len(own)) - d, 0) / nk + d * vk / nk * p) if nk else math.log10(p)
            logs.append(total)
        if "y" * 900 in (by_id[r.doc_id][0] or ""):
            continue
        assert r.score == pytest.approx(math.log10(sum(10 ** (x - max(logs)) for x in logs)) + max(logs), rel=1e-6)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame(make(10), DOCS)
    assert lm.lm_score(docs.limit(0), PATH).count() == 0
    alone = lm.lm_score(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1"), PATH).collect()
    assert alone and all(r.held_out and r.train_tokens == 0 and r.score < 0 for r in alone)


def test_longest_pieces_are_in():
    lattice = lm.Lattice.start(PATH)
    assert lattice.longest == len(" становништво".encode()) == 25
    word = "становништво".encode()
    longest = lattice.pieces.index(b" " + word)
    assert lattice.expected([word])[0][longest] > 0
    assert lattice.score([word])[0] == pytest.approx(by_hand(lattice, word)[0], rel=1e-9)
