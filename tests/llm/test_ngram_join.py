"""Components of all links against brute force over all pairs."""

import random

import pytest

from peerlens.llm import ngram_join as nj
from peerlens.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((repr(d), len(sets[i]), repr(low.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def edited(rng, words, rate):
    return [rng.choice("qwertz") if rng.random() < rate else w for w in words]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    passage = [f"p{k}" for k in range(40)]
    for base in range(25):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(1, 7)):
            own = edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06]))
            if rng.random() < 0.4:
                own = own[: rng.randrange(len(own) + 1)] + passage + own[rng.randrange(len(own)) :]
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  TWO"), (rows[0][0], rows[0][1]), (None, rows[1][1]), (2005, "one"), (None, "alone here")]
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 3), (3, 8)])
def test_components_match_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = corpus(seed)
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows)


def test_empty_and_stage(spark):
    assert nj.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text, "x"), (3, text + " more", "y"), (9, "other", "z"), (10, None, "n"), (5, "another text", "w")], "doc_id long, text string, key string")
    assert sorted((r.doc_id, r.key) for r in nj.one_of_each(docs).collect()) == [(3, "y"), (5, "w"), (9, "z"), (10, "n")]


def test_one_row_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(4, a, "p"), (4, a, "o"), (None, a, "q"), (4, a + " more", "r"), (None, b, "s"), (None, b, "s"), (None, b + " more", "t"), (8, "other", "u"), (None, None, "v"), (None, None, "v"), (8, "else", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = [tuple(r) for r in nj.one_of_each(docs).collect()]
    assert sorted(r[2] for r in got if r[1] in ("other", "else", None)) == ["u", "v", "v", "w"]
    linked = [r for r in got if r[1] not in ("other", "else", None)]
    assert len(linked) == 2 and {r[0] for r in linked} == {4, None}
    assert [r[2] for r in linked if r[0] == 4] in (["o"], ["r"])


def test_components(spark):
    rng = random.Random(7)
    for edges in ([(k, k + 1) for k in range(40)], [(1, k) for k in range(2, 50)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]):
        got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        parent = {v: v for e in edges for v in e}
        for _ in range(80):
            for a, b in edges:
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert got == {v: p for v, p in parent.items() if any(a != b and v in (a, b) for a, b in edges)}


def test_hot_elements_fold_within_a_batch():
    """An element of very many classes is one entry that goes on; what it tells is kept."""
    import numpy as np

    tokens = np.array([7] * 5000 + [8, 9, 9], np.uint64)
    keys = np.array([*range(5000), 1, 2, 2], np.int64)
    t, k, told = nj.fold_to_stars(tokens, keys)
    assert list(zip(t.tolist(), k.tolist(), strict=True)) == [(7, 0), (8, 1), (9, 2)]
    pairs = np.frombuffer(told[0][1], "<i8").reshape(-1, 2)
    assert told[0][0] < 0 and {tuple(p) for p in pairs.tolist()} == {(i, 0) for i in range(1, 5000)}
    t, k, told = nj.fold_to_counts(4)(tokens, keys)
    assert sorted(zip(t.tolist(), k.tolist(), strict=True)) == [(7, nj._COUNTED), (8, 1), (9, 2)]
    counted = np.concatenate([np.frombuffer(raw, nj._COUNT) for _, raw in told])
    assert len(counted) == 5000 and set(counted["n"].tolist()) == {1}
    (rows,) = nj._counter(4)(np.array([7, 7, 8], np.uint64), np.array([nj._COUNTED, 3, 1], np.int64))
    assert [np.frombuffer(r, nj._COUNT).tolist() for r in rows.column("raw").to_pylist()] == [[(3, 1)]]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    assert [len(x) for x in nj.fold_to_stars(*none)] == [len(x) for x in nj.fold_to_counts(4)(*none)] == [0, 0, 0]


def test_maps_grow_with_the_classes(spark):
    import numpy as np

    assert nj.map_bits(0) == nj.map_bits(100) == nj.LEAST_BITS
    assert all(nj.map_bits(n) >= nj.BITS_A_CLASS * n for n in (300_000, 3_000_000))
    keys = [5, -1, 1 << 40, -(1 << 63), 77]
    known = nj._bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), nj.LEAST_BITS)
    assert nj._only(known, np.array(keys)).all() and np.unpackbits(known).sum() == len({k % nj.LEAST_BITS for k in keys})
    assert not nj._only(known, np.array([6, 7, -2])).any()


def test_sets_that_link_have_neighbouring_bands(spark):
    pairs = [(n, m) for n in (1, 3, 4, 5, 12, 100, 999, 65_536) for m in (n, (4 * n) // 3)]
    rows = spark.createDataFrame(pairs, "n long, m long").select(nj.band_of(nj.F.col("n")).alias("a"), nj.band_of(nj.F.col("m")).alias("b")).collect()
    assert all(0 <= r["b"] - r["a"] <= 1 for r in rows)


def test_a_large_group_meets_neighbouring_bands_only(spark, monkeypatch):
    """Chains of texts of many sizes that share a passage: one candidate group, in small blocks."""
    monkeypatch.setattr(nj, "BLOCK", 2)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[: int(12 * 1.2**k)])) for k in range(18)] + [(100 + k, " ".join([*words[: int(12 * 1.2**k)], "x"])) for k in range(18)]
    got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_what_a_stored_table_shuffled_is_gone(spark):
    import time

    from peerlens.llm import common

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    out = common.stored(spark.range(10_000).repartition(7, "id"), "gone")
    wait = time.monotonic() + 10
    while files() > before and time.monotonic() < wait:
        time.sleep(0.1)
    assert files() <= before and out.count() == 10_000
    assert spark.conf.get(common.CLEANUP, "false") == "false"


def test_blocks_meet_in_rounds(spark, monkeypatch):
    """Where more meets than fits, a share of the pairs of blocks after the other, and all links are found."""
    monkeypatch.setattr(nj, "BLOCK", 3)
    monkeypatch.setattr(nj, "rounds_for", lambda sent, once: 3 if sent >= once > 0 else 0)
    rows = corpus(2)
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows)


def test_counters_grow_with_the_elements(spark):
    import numpy as np

    assert nj.rounds_for(None, None) == nj.rounds_for(nj.ROUND, 5) == 1 and nj.rounds_for(10 * nj.ROUND, nj.ROUND) == 5
    assert nj.cells_for(0) == nj.CELLS and nj.cells_for(16 * nj.CELLS) >= 2 * nj.CELLS and nj.cells_for(1 << 40) == nj.MOST_CELLS
    sets = spark.createDataFrame([(1, np.array([5, 70_000, 5 + 128], np.uint64).tobytes())] * 70_000, "key long, raw binary")
    counted = nj._frequencies(sets.repartition(3), 128)
    assert counted.dtype == np.uint16 and counted[5] == 65_535 and counted[70_000 % 128] == 65_535 and counted.astype(int).sum() == 2 * 65_535
