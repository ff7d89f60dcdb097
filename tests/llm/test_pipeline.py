"""The pipeline against a plain Python version of its stages, each on what the one before kept."""

import random
import re
import zlib

import public_tokenizers
from test_decontaminate import brute as scan
from test_native import brute_lines
from test_ngram_join import brute as comps
from tokenizers import Tokenizer

import corpus_pipeline as cp
from peerlens.llm import line_dedup, quality_crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def write(spark, rows, labels, items, path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def corpus():
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + "."
    item = " ".join(f"b{k}" for k in range(25))
    shared = line(60)
    rows = [(k, "\n".join(line(rng.randrange(4, 30)) for _ in range(rng.randrange(1, 7)))) for k in range(120)]
    rows += [(200 + k, "\n".join("SHOUT!! " * 20 + f"X{k}!!" for _ in range(3))) for k in range(40)]
    rows += [(300 + k, shared + "\n" + line(40)) for k in range(5)]
    base = [f"n{k}" for k in range(120)]
    rows += [(400 + k, " ".join([*base[: 20 * k], f"e{k}", *base[20 * k :]])) for k in range(5)]
    rows += [(500, line(10) + " " + item), (501, line(900) + " " + item), (502, rows[5][1]), (503, None), (504, "")]
    labels = [(r[0], int(not 200 <= r[0] < 300), 0) for r in rows if r[0] % 2]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], labels, [(1, item)]


def test_stages_match_plain_python(spark, tmp_path):
    rows, labels, items = corpus()
    write(spark, rows, labels, items, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text_of = {}
    stages = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        stages.append(docs.collect())
    good, lined, single, clean, pieces = stages
    assert all(d.columns == list(cp.COLUMNS) for d in [spark.read.parquet(f"{tmp_path}/out/{n}") for n, _ in cp.STAGES[:-1]])

    # The classifier's verdicts come from its operator; all junk and no clean text is rejected.
    ids = {r.doc_id for r in good}
    assert not any(200 <= i < 300 for i in ids) and ids >= {r[0] for r in rows if r[0] < 200 or 300 <= r[0] < 503}

    want = brute_lines([(r.doc_id, r.text) for r in good], line_dedup.MIN_WORDS)
    text_of = {d: kept for (d, t), (kept, gone) in want.items() if not gone or WORD.search(kept)}
    assert {r.doc_id: r.text for r in lined} == text_of and 502 not in text_of

    components = {d: c for d, _, c in comps(list(text_of.items()))}
    stay = {d: t for d, t in text_of.items() if repr(d) == components[repr(d)]}
    assert {r.doc_id: r.text for r in single} == stay and not {401, 402, 403, 404} & set(stay)

    stay = {d: t for d, t in stay.items() if not (lambda n, h, _: h and 20 * h >= n)(*scan(t, items))}
    assert {r.doc_id: r.text for r in clean} == stay and 500 not in stay and 501 in stay

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in stay.items():
        own = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own[at : at + r.length])) == r.ids_crc32
            at += r.length
        assert at == len(own)
    assert cp.run(spark, str(tmp_path)).count() == len(pieces)


def test_null_columns_and_empty(spark, tmp_path):
    rows, labels, items = corpus()
    odd = [(None, None, None, None, None), (7, "some words here", None, None, None), (7, "some words here", None, None, None)]
    write(spark, odd, labels, items, tmp_path / "a")
    write(spark, [], [], [], tmp_path / "b")
    got = cp.run(spark, str(tmp_path / "a")).collect()
    # Equal rows are linked, so one of them stays.
    assert sorted(repr(r.doc_id) for r in got if r.start == 0) == ["7", "None"]
    assert cp.run(spark, str(tmp_path / "b")).count() == 0
    assert quality_crf.TRAIN_DOCUMENTS > 0
