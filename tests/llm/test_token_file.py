"""Round trips of the coder, its checksums, and whole files against the tokenizer."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from peerlens.llm import common
from peerlens.llm import token_file as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 700), st.integers(1, 50_000), st.integers(0, 9), st.sampled_from([16, 64, 1024]))
def test_round_trip(n, top, seed, block):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(min(1.0, 5 / top), n), top).astype(np.uint32)
    if seed % 2:
        ids = np.resize(ids[: max(1, n // 7)], n)
    names, sizes, back = tf.unpack_segment(tf.pack_segment([5, None], np.array([n - n // 2, n // 2]), ids[:n], block))
    assert names == [5, None] and sizes.tolist() == [n - n // 2, n // 2] and (back == ids[:n]).all()


def test_any_change_is_noticed_and_blocks_are_independent():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    body = tf.pack_segment([1], np.array([5000]), ids)
    for at in range(0, len(body), 97):
        broken = bytearray(body)
        broken[at] ^= 4
        with pytest.raises((tf.ChecksumError, tf.struct.error)):
            tf.unpack_segment(bytes(broken))
    distinct, shares, blocks = tf.encode_blocks(ids, 1024)
    assert (tf.decode_blocks(distinct, shares, blocks[2:3], 1024) == ids[2048:3072]).all()


def test_repetition_is_cheap():
    ids = np.tile(np.random.default_rng(2).integers(0, 40_000, 150), 200).astype(np.uint32)
    assert len(tf.pack_segment([1], np.array([len(ids)]), ids)) < 0.35 * len(ids)


def test_file(spark, tmp_path):
    rows = [(k * 3 % 50, f"Doc {k} says: the thing, and {k * k} more.\nÜber  ") for k in range(50)] + [(60, None), (61, ""), (None, "no id"), (3, "again"), (70, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tf.write_tokens(df, str(tmp_path / "t"), PATH, segment_tokens=100, block=64)
    got = tf.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    plain = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        want.append((doc_id, np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")))
    start = 0
    for r, (doc_id, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    tf.write_tokens(df.limit(0), str(tmp_path / "e"), PATH)
    assert tf.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_coding_takes_few_steps_of_the_processor():
    ids = np.minimum(np.random.default_rng(3).zipf(1.3, 2_000_000), 40_000).astype(np.uint32)

    def seconds(f) -> float:
        began = time.process_time()
        f()
        return time.process_time() - began

    def both():
        assert (tf.decode_blocks(*tf.encode_blocks(ids))[: len(ids)] == ids).all()

    # Against as many plain additions, as machines differ: it takes 25 times as long, and took 52 times.
    plain = min(seconds(lambda: sum(range(2_000_000))) for _ in range(9))
    assert min(seconds(both) for _ in range(2)) < 38 * plain


def test_signs_are_cut_off_words_only_where_no_token_crosses():
    for name, space in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        # A capital with a dot becomes a letter and a mark, which goes with the signs.
        texts = ["\u0130. a", "b \u0130### c", "\u0958. d", "word### a,. b.%%% (c). \u2026. e'## f", "g" * 1100 + " h.", "", "\0 a", "i.\nj&&&"]
        # Capitals are folded, but not those that a mark behind them may belong to.
        texts += ["The THE the It'S J\u030c E\u0301a E", "Q. q. [A] Z@"]
        ids, counts = common.CachedEncoder(path, space).encode(texts)
        for text, end, n in zip(texts, np.cumsum(counts), counts, strict=True):
            assert ids[end - n : end].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_pieces_keep_their_numbers():
    names = common.mix64(np.arange(1, 50_001, dtype=np.uint64))
    names[:300] = np.arange(1, 301)  # one slot for all
    index, at = common._Names(), 0
    for n in (0, 1, 299, 700, 20_000, 29_000):
        index.add(names[at : at + n])
        at += n
        assert (index.find(names) == np.where(np.arange(len(names)) < at, np.arange(len(names)), -1)).all()
    data = np.frombuffer(b"abc abd abcdefgh abcdefghi abcdefghj abc" + bytes(8), np.uint8)
    begin, sizes = np.array([0, 4, 8, 17, 27, 37]), np.array([3, 3, 8, 9, 9, 3])
    got = common.piece_names(data, begin, sizes).tolist()
    assert got[0] == got[5] and len(set(got)) == 5
