"""Against plain Python: ties, repeated ids and items, nulls, many shards and blocks."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from peerlens.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for d, c in held:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def found(spark, docs, items, **sizes):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, item string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, block int")
    out = rs.search(d, q, **sizes)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 7, "block_bytes": 60, "top": 9}, {"shard_postings": 20, "top": 3}])
def test_against_plain_python(spark, sizes):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "The", "DE", "é", "Éa", "x1", "漢字", "b_c", "u" * 40, "q"]) + str(rng.choice(["", "", 1, 22]))
    text = lambda n: rng.choice([" ", ", ", "\n", "--"]).join(word() for _ in range(n))
    docs = [(k, text(rng.randrange(0, 40))) for k in range(150)]
    docs += [(200 + k, docs[3][1]) for k in range(60)] + [(5, docs[5][1]), (None, docs[3][1]), (None, "a b"), (300, None), (301, ""), (302, "!? ..."), (303, "the " * 30_000)]
    items = [(k, text(rng.randrange(1, 12))) for k in range(12)] + [(3, "more words of item x1"), (None, "a the"), (None, "q"), (50, None), (51, "zzz unknown"), (52, "...")]
    got = found(spark, docs, items, **sizes)
    assert got == brute(docs, items, sizes.get("top", 50)) and len(got) > 20


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a"), (2, None)], [])
    assert found(spark, [(1, None)], [(1, "a")]) == []
