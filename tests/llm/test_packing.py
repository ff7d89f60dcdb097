"""Every id once, sequences filled, crcs and costs."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from peerlens.llm import common, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " a", "a  b", "x\n\ny z", "tail ", "don't 'll <|endoftext|> a", "é́   b", "a,. b.", "a. b, c.\nD", "word " * 3000, "\x1c a\x1c b", "1.5, 2.\n3", "a\0b. c", "x.\n", ".", "., ."]


def test_encoder_equals_library():
    for name, space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        texts = [t or "" for t in ODD] * 2
        ids, counts = common.CachedEncoder(path, space, most=10).encode(texts)
        at = 0
        for text, n in zip(texts, counts, strict=True):
            assert plain.encode(text, add_special_tokens=False).ids == ids[at : at + n].tolist(), text
            at += n


def test_pack(spark):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id")]
    for group in (50, 1 << 20):
        rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), PATH, group_tokens=group, length=64, with_ids=True).collect()
        plain = Tokenizer.from_file(PATH)
        per_doc, per_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            per_doc[r.doc_id].append(r)
            per_seq[r.sequence_id].append(r)
        for doc_id, text in docs:
            want = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            pieces = sorted(per_doc[doc_id], key=lambda r: r.start)
            times = sum(d[0] == doc_id for d in docs)
            assert sum(r.length for r in pieces) == times * len(want) and all(r.doc_tokens == len(want) for r in pieces)
            for r in pieces:
                assert r.ids == want[r.start : r.start + r.length].tobytes()
        for pieces in per_seq.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_assign_balances_cost():
    sizes = np.random.default_rng(1).integers(1, 500, 2000)
    cost = defaultdict(float)
    for _, _, n, seq, _ in packing.assign(sizes, 1024):
        cost[seq] += n + n * n / 1024
    full = sorted(cost.values())[5:]
    assert max(full) < 1.6 * min(full)
