"""Very long texts, and columns that are called like inner ones, in the operators that read documents."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from peerlens.llm import lm_score, ngram_join, packing, token_file

NAMES = "doc_id long, text string, lang string, body string, key int, raw string, th int, gone int, train int, kind string, h int, part int, start string, ids int, h_ int, word string"
MORE = ("b", 1, "r", 2, 3, 4, "k", 5, 6, "s", 7, 8, "w")


def rows(texts):
    return [(k, t, "en", *MORE) for k, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    return [(1, long), (2, long + " and a little more"), (3, "a short text, of few words"), (4, None), (5, ""), (6, "x" * 100_000)]


def test_token_file(spark, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_file.write_tokens(spark.createDataFrame(rows(texts), NAMES), str(tmp_path / "t"), path)
    plain = Tokenizer.from_file(path)
    for r in token_file.read_tokens(spark, str(tmp_path / "t")).collect():
        ids = [*plain.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))


def test_packing(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(spark.createDataFrame(rows(texts), NAMES), path).collect()
    plain = Tokenizer.from_file(path)
    for doc, text in texts:
        n = len(plain.encode(text or "", add_special_tokens=False).ids) + 1
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and sum(p.length for p in own) == n


def test_ngram_join(spark, texts):
    docs = spark.createDataFrame([*rows(texts), (1, texts[0][1], "en", *MORE)], NAMES)
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)}
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 5, 6]
    assert {tuple(r)[3:] for r in left.collect()} == {MORE}


def test_lm_score(spark, texts):
    got = {r.doc_id: r for r in lm_score.lm_score(spark.createDataFrame(rows(texts), NAMES), public_tokenizers.path("piece_bpe_32k.model"), rounds=1).collect()}
    assert len(got) == 6 and got[1].n_tokens == 60_001 and got[6].n_tokens == 2
    assert all(-1e7 < r.score < 0 for r in got.values())
