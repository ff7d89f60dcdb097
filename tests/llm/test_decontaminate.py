"""The suffix automaton against window sets."""

import hashlib
import random
import re

from peerlens.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=13):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        own = WORD.findall(lower(item))
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add("" if name is None else str(name))
    return len(words), len(hit), sorted(found)


def case(seed):
    rng = random.Random(seed)
    vocab = [f"W{k}é" if k % 3 else f"w{k}" for k in range(6)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30)))) for k in range(12)]
    items += [(100, None), (None, "w0 W1é w3 w3"), (101, items[0][1]), (102, "...")]
    docs = [(k, " ".join(rng.choice([*vocab, "x"]) for _ in range(rng.randrange(0, 80)))) for k in range(60)]
    docs += [(70 + k, "foo, " + " ".join(rng.choice(["bar"] * 20) for _ in range(k * 40)) + "; " + (i[1] or "")) for k, i in enumerate(items)]
    return docs + [(200, None), (201, ""), (0, docs[0][1])], items


def test_scan_matches_brute_force(spark):
    for seed, size in ((1, d.BLOCK_BYTES), (2, 300)):
        docs, items = case(seed)
        got = d.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=size).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, items), r
            assert sum(s.e - s.b for s in r.spans) == r.n_hit


def test_modes_and_edges(spark):
    item = " ".join(f"q{k}" for k in range(20))
    docs = spark.createDataFrame(
        [(1, "Before. " + item + " after", 5), (2, "clean text", 6), (3, None, 7), (4, " ".join(["z"] * 1000) + " " + item, 8)], "doc_id long, text string, n_hit int"
    )
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in d.decontaminate(docs, bench).collect()) == [2, 3, 4]
    assert {r.doc_id: r.text for r in d.decontaminate(docs, bench, mode="cut").collect()}[1] == "Before.  after"
    assert d.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert d.scan(docs.limit(0), bench).count() == 0
    assert d.items_digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()


def test_clashing_columns_and_very_long_texts(spark):
    item = " ".join(f"q{k}" for k in range(20))
    long = "w " * 200_000 + item
    rows = [(1, "x " + item, "a", 1, "s", b"1", 2), (2, long, "b", 2, "t", b"2", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items string, n_hit int, spans string, bytes binary, doc int")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    (left,) = d.decontaminate(docs, bench).collect()
    assert left.asDict() == {"doc_id": 2, "text": long, "items": "b", "n_hit": 2, "spans": "t", "bytes": b"2", "doc": 3}
    cut = {r.doc_id: r for r in d.decontaminate(docs, bench, mode="cut").collect()}
    assert (cut[1].text, cut[1]["items"], len(cut[2].text)) == ("x ", "a", 400_000)
    assert d.scan(docs.drop("items", "n_hit", "spans"), bench).where("doc_id = 2").collect()[0].bytes == b"2"
