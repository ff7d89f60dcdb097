"""Against plain Python: ties, nulls, repeated ids, vectors of several lengths, large values, many small blocks."""

import math
import random

import pytest

from peerlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block int, k int, row int, info string"


def brute(rows, every, positives=5, negatives=5, low=80, high=100):
    best = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        one = (label, [math.floor(256 * c) for c in x])
        best[vec_id] = min(best.get(vec_id, one), one)
    out = []
    for anchor, (label, x) in best.items():
        if anchor % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i, other) for i, (other, y) in best.items() if i != anchor))
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [(-t, i) for t, i, other in scored if other != label and low * -s <= -100 * t <= high * -s]
            out += [(anchor, p, k + 1, n, -s, t) for k, (t, n) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, data, every=10, **sizes):
    df = spark.createDataFrame([(*r, "v", 1, 2, 3, "i") for r in data], SCHEMA).repartition(3)
    out = hn.mine(hn.scaled(df), every, **sizes)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("blocks", [{}, {"rows": 16, "anchors": 3, "dims": 3, "piece": 2}])
def test_against_plain_python(spark, blocks):
    rng = random.Random(5)
    pick = lambda n: [rng.choice([-0.5, -0.01, 0.0, 0.25, 0.5, 1.0]) for _ in range(n)]  # noqa: E731  few values, so many ties
    rows = [(k, pick(8), rng.choice([0, 1, 1, 1, 2, 40, -3])) for k in range(260)]
    rows += [(300, pick(8), None), (310, None, 1), (320, [*pick(7), None], 1), (330, [*pick(7), math.nan], 1), (340, [*pick(7), math.inf], 1), (None, pick(8), 1)]
    rows += [(400, pick(3), 1), (410, [], 1), (420, pick(20), 1), (20, pick(8), 0), (20, rows[20][1], rows[20][2]), rows[30]]
    got = mined(spark, rows, **blocks)
    assert got == brute(rows, 10) and len(got) > 200


def test_large_values_and_copies(spark):
    """Scores beyond what doubles hold, and one vector that a third of all rows have."""
    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(100_000, 1_000_000) * rng.choice([1, 1, -1])) for _ in range(5)], k % 2) for k in range(40)]
    rows += [(k, [3e5] * 5, k % 3) for k in range(40, 80)]
    assert mined(spark, rows, rows=8, dims=2) == brute(rows, 10)


def test_none(spark):
    assert mined(spark, []) == [] == mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    assert mined(spark, [(10, [1.0], 1), (2, [1.0], 2)]) == []
