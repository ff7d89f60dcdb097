"""Queries over all of their input, against plain Python."""

import math
from collections import Counter

import pytest
from conftest import SF

from peerlens.operators import bm25
from peerlens.queries import QUERIES


def bm25_by_hand(docs, asked):
    """(query, doc): score over whole texts."""
    words = {i: Counter((t or "").lower().split()) for i, t in docs}
    size = {i: sum(c.values()) for i, c in words.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in words.values() for w in c)
    raw = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for query, terms in asked.items():
        for i, c in words.items():
            hit = [t for t in terms if c[t]]
            if hit:
                out[query, i] = sum((floor if raw[t] < 0 else raw[t]) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / mean)) for t in hit)
    return out


def test_bm25_of_whole_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = bm25_by_hand(docs, {"a": ["the", "license", "license"], "b": ["und", "der"]})
    got = {(r.query, r.doc): r.score for r in QUERIES["bm25_scores"](spark, SF).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    text_of = dict(docs)
    assert any("und" in text_of[d].lower().split() and "und" not in text_of[d][:200].lower().split() for q, d in got if q == "b")
    best = {(r.query, r.doc): r.score for r in QUERIES["bm25_tag_top15"](spark, SF).collect()}
    ranked = {q: sorted(((k, v) for k, v in want.items() if k[0] == q and v >= bm25.TAG_LEAST), key=lambda x: (-round(x[1], 9), x[0][1])) for q in "ab"}
    assert best == {k: pytest.approx(v, abs=2e-6) for q in "ab" for k, v in ranked[q][: bm25.TAG_TOP]}
    taken = []
    for q in "ab":
        left = [(k, v) for k, v in want.items() if k[0] == q and v > bm25.SECTION_LEAST and k[1] not in [d for (_, d), _ in taken]]
        taken += sorted(left, key=lambda x: (-x[1], x[0][1]))[:1]
    assert {(r.query, r.doc): r.score for r in QUERIES["bm25_greedy_sections"](spark, SF).collect()} == {k: pytest.approx(v, abs=2e-6) for k, v in taken}


def test_risks_that_begin_alike_stay(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {}
    for i, t in sorted(docs):
        want.setdefault(t.strip(" ").lower(), i)
    got = [(r.name, r.seq) for r in QUERIES["risk_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(want.items())
    assert len(want) > len({t[:40].strip(" ").lower() for _, t in docs})


def test_all_others_are_peers(spark):
    sf = SF.replace("0.001", "0.01")
    region = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{sf}/nation.parquet").collect()}
    supplier = {r.s_suppkey: (r.s_name, region[r.s_nationkey]) for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    want = sorted(name for k, (name, home) in supplier.items() if k and home == supplier[0][1])
    assert any(supplier[k][0] in want for k in supplier if k % 5)
    for name in ("competes_with", "operates_in_edges"):
        assert sorted(r.src for r in QUERIES[name](spark, sf).collect()) == want
    metrics = [(r.category, r.peer) for r in QUERIES["peer_metrics_by_category"](spark, sf).collect()]
    assert metrics == sorted((c, p) for c in {c for c, _ in metrics} for p in want)[:20]
    nested = [(r.category, r.peer) for r in QUERIES["nested_dedup"](spark, sf).collect()]
    assert {p for _, p in nested} <= set(want) and sorted(p for c, p in nested if c == min(nested)[0]) == want[:20]
    others = sorted({r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect()} - {"src0"})
    for name in ("peer_risks_all", "peer_risks_by_topic"):
        assert [r.peer for r in QUERIES[name](spark, sf).collect()] == others


def test_every_part_is_written(spark):
    last = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").select("p_brand", "p_type", "p_partkey").collect():
        last[r.p_brand, r.p_type] = max(r.p_partkey, last.get((r.p_brand, r.p_type), -1))
    assert {(r.brand, r.type): r.n for r in QUERIES["metric_upsert_last_write"](spark, SF).collect()} == last


def test_truth_of_all_years(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    tag = {r.p_partkey: r.p_brand for r in read("part")}
    filed = {r.o_orderkey: r.o_orderdate for r in read("orders")}
    groups, ours = {}, {}
    for r in read("lineitem"):
        key, date = (r.l_suppkey, tag[r.l_partkey]), filed[r.l_orderkey]
        groups.setdefault(key, []).append((r.l_linenumber % 3 == 0, r.l_linenumber % 4 != 0, str(r.l_shipdate)[:10], str(date)[:10], r.l_extendedprice, r.l_returnflag in "RA"))
        k = (*key, str(r.l_shipdate)[:4])
        ours[k] = max(r.l_extendedprice, ours.get(k, 0))
    want = {}
    for key, rows in groups.items():
        rows = [r for r in rows if r[0] == min(x[0] for x in rows)]
        usd = any(r[1] for r in rows)
        for r in rows:
            if r[1] == usd and r[5]:
                for year in {r[2][:4], r[3][:4]}:
                    place = (r[2], r[3], -r[4])
                    want[(*key, year)] = max(place, want.get((*key, year), place))
    got = {(r.cik, r.tag, r.year): (r.end, r.filed, -r.val) for r in QUERIES["ground_truth_best"](spark, SF).collect()}
    assert got == want and {"1995", "2001"} <= {k[2] for k in got}
    counted = {r.year: r for r in QUERIES["value_match_2pct"](spark, SF).collect()}
    assert set(counted) == {k[2] for k in ours}
    for year, r in counted.items():
        mine = [k for k in ours if k[2] == year]
        assert r.n_match + r.n_mismatch == sum(k in want for k in mine) and r.n_not_found == sum(k not in want for k in mine)
        assert r.n_match == pytest.approx(sum(k in want and abs(ours[k] + want[k][2]) <= 0.02 * abs(want[k][2]) for k in mine), abs=1)
