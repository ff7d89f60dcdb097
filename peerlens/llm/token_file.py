"""Token ids in compressed binary segments, written and read back.

A segment holds whole documents in ascending order of doc_id. It starts with the documents' ids and numbers of tokens and
a table of how often each token id occurs (the order-0 prediction); then come blocks of `BLOCK` ids, each coded on its own
and with a checksum of its own. Within a block two tables learn which id follows the last one (order 1) and the last two
(order 2), with a confidence; for every pair of confidences, hits counted so far in the block mix the three predictions into
one distribution, by which a range coder codes the id. All blocks of a segment are coded side by side, as rows of numpy
arrays, so that a step costs a few dozen calls for thousands of ids.

Segments are rows of a Parquet table (part, number in the part, documents, tokens, bytes), so any store that Spark writes
can hold them, and a lost task writes its own part again.

Defined cases: a null or empty text is its end id alone; a null doc_id sorts first; rows that repeat a doc_id follow one
another by text; an empty table gives an empty file; a very long text's ids stay together in one segment, which grows with
them. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"PLTK\x02"
BLOCK = 4096
SEGMENT_TOKENS = 8 << 20
STATIC = 20
#: Entries of a block's table of each order.
SLOTS = 1024
#: Contexts of the weights; steps after which these are set anew.
KINDS, EVERY = 32, 128
_NONE, _HASH = 1 << 26, 0x2F0D5
_SURER, _SUREST = np.array([[4], [1]], np.int32), np.array([[12], [3]], np.int32)
#: A range below the first makes room for a word of 24 bits, so each has 28 to 52 bits.
_SMALL, _WORD = float(1 << 28), float(1 << 24)
_SCHEMA = "part long, number long, n_docs long, n_tokens long, body binary"


class ChecksumError(ValueError):
    pass


class _Model:
    """Predictions for many blocks at once; the coder and the decoder drive equal copies of it.

    A table's entry is an id with, in its low four bits, how often in a row it has been right (order 2: 4 to 12, order 1:
    1 to 3). Row 0 of the arrays is order 2, row 1 order 1. What both orders' confidences say, and whether they agree on the
    id, is the context of the weights; these come from the block's hits so far and are set anew at the steps of `_due`.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int64)
        # Entries that are empty differ from each other and from all ids.
        self.table = np.repeat(np.array([_NONE << 4, (_NONE + 1) << 4], np.int32), lanes * SLOTS)
        self.base = np.stack([lane, lane + lanes]) * SLOTS
        self.slot, self.entry = np.empty((2, lanes), np.int64), np.empty((2, lanes), np.int32)
        self.both, self.beside = np.empty(lanes, np.int32), np.empty(lanes, np.int32)
        self.mixed, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.own = lane * KINDS
        self.kinds, self.hits = np.empty((EVERY, lanes), np.int64), np.empty((EVERY, 2, lanes), bool)
        self.seen, self.right = np.zeros(lanes * KINDS), np.zeros((2, lanes * KINDS))
        self.limits, self.step, self.noted = np.empty((2, lanes * KINDS)), 0, 0
        self.limit = np.empty((2, lanes))
        kind = np.arange(lanes * KINDS) % KINDS
        self.has2, self.has1 = (kind & 12) > 0, ((kind & 3) > 0) & (kind >= 16)
        self._weigh()

    def _weigh(self) -> None:
        """The shares of the two candidates, one above the other; order 0 keeps a sixteenth at least."""
        two, both = self.limits
        np.divide(self.right[0] + 1.0, self.seen + 2.5, out=two)
        np.clip(two, 1 / 256, 7 / 8, out=two)
        two *= self.has2
        one = (self.right[1] + 0.5) / (self.seen - self.right[0] + 2.5)
        np.clip(one, 1 / 32, 7 / 8, out=one)
        one *= self.has1
        np.minimum(two + (1 - two) * one, 15 / 16, out=both)

    def predict(self) -> np.ndarray:
        """Sets both entries; gives the upper limits, as shares of the whole, of order 2's candidate and of order 1's."""
        slot = self.slot
        np.add(self.mixed, self.last, out=slot[0])
        slot[1] = self.last
        slot &= SLOTS - 1
        slot += self.base
        self.table.take(slot, out=self.entry, mode="clip")
        # The confidences alone where both name one id, else and 16.
        np.bitwise_xor(self.entry[0], self.entry[1], out=self.both)
        np.bitwise_and(self.both, 15, out=self.beside)
        self.beside |= 16
        np.minimum(self.both, self.beside, out=self.both)
        kind = self.kinds[self.noted]
        np.add(self.both, self.own, out=kind)
        return self.limits.take(kind, axis=1, out=self.limit, mode="clip")

    def learn(self, ids: np.ndarray) -> np.ndarray:
        """Takes the ids that came; whether each order's entry was right."""
        shifted = (ids << 4).astype(np.int32)
        new = self.entry ^ shifted
        right = np.less(new, 16, out=self.hits[self.noted])
        new += _SURER
        np.minimum(new, _SUREST, out=new)
        new = np.where(right, new, _SURER)
        new += shifted
        self.table[self.slot] = new
        np.multiply(self.last, _HASH, out=self.mixed)
        self.last[:] = ids
        self.step += 1
        self.noted += 1
        if self.noted == EVERY or self.step < EVERY and not self.step & (self.step - 1):
            self._note()
        return right

    def _note(self) -> None:
        kinds, right = self.kinds[: self.noted].ravel(), self.hits[: self.noted]
        two, one = right[:, 0].ravel(), (right[:, 1] & ~right[:, 0]).ravel()
        for sums, own in ((self.seen, kinds), (self.right[0], kinds[two]), (self.right[1], kinds[one])):
            sums += np.bincount(own, minlength=len(sums))
        self.noted = 0
        self._weigh()


class _Coder:
    """Ranges of many blocks at once, as whole numbers below 2^52 in doubles, so that all products and sums are exact."""

    def __init__(self, lanes: int, shares: np.ndarray):
        self.shares = shares.astype(np.float64)
        self.starts = np.cumsum(self.shares) - self.shares
        self.width = np.full(lanes, float((1 << 52) - 1))
        self.cuts, self.free = np.zeros((3, lanes)), np.empty((2, lanes))
        self.unit = np.empty(lanes)

    def divide(self, limits: np.ndarray) -> np.ndarray:
        """Cuts the ranges: where order 2's and order 1's candidates end, and the unit of order 0's shares of the rest."""
        ends = limits * self.width
        np.floor(ends, out=ends)
        self.cuts[1] = ends[0]
        np.subtract(ends[1], ends[0], out=self.cuts[2])
        np.subtract(self.width, ends[1], out=self.unit)
        self.unit *= 2.0**-STATIC
        np.floor(self.unit, out=self.unit)
        return ends

    def narrow(self, ids: np.ndarray, any_hit: np.ndarray, hit2: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Takes the ids' parts of the ranges; where they start."""
        free = self.free
        self.starts.take(ids, out=free[0], mode="clip")
        self.shares.take(ids, out=free[1], mode="clip")
        free *= self.unit
        free[0] += ends[1]
        np.copyto(free, self.cuts[1:], where=any_hit)
        np.copyto(free, self.cuts[:2], where=hit2)
        self.width[:] = free[1]
        return free[0]

    def widen(self, small: np.ndarray) -> np.ndarray:
        """Where the range has become small, its first 24 bits are settled: gives the factor that makes room."""
        np.less(self.width, _SMALL, out=small)
        factor = np.where(small, _WORD, 1.0)
        self.width *= factor
        return factor


def _shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, their numbers, scaled to sum to 2^STATIC with at least 1 each, and each id's place among the distinct."""
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        counts, place = counts[distinct], np.zeros(len(counts), np.int32)
        place[distinct] = np.arange(len(distinct))
        index = place[ids]
    else:
        distinct, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    total, room = int(counts.sum()), (1 << STATIC) - len(distinct)
    scaled = 1 + counts * room // total
    scaled[int(np.argmax(scaled))] += (1 << STATIC) - int(scaled.sum())
    return distinct, scaled, index


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The table (distinct ids, shares) and every block's bytes."""
    distinct, shares, index = _shares(ids)
    lanes = -(-len(index) // block)
    steps = np.full(lanes * block, index[-1], np.int32)
    steps[: len(index)] = index
    steps = np.ascontiguousarray(steps.reshape(lanes, block).T)
    model, coder = _Model(lanes), _Coder(lanes, shares)
    low, full = np.zeros(lanes), np.empty(lanes)
    # A step's word is kept where it is settled; it may have a 25th bit, which belongs to the word before.
    words, settled = np.empty((block + 1, lanes), np.int32), np.ones((block + 1, lanes), bool)
    place, places = np.zeros(lanes, np.int32), np.empty((block + 1, lanes), np.int32)
    for t in range(block):
        own = steps[t].astype(np.int64)
        ends = coder.divide(model.predict())
        right = model.learn(own)
        low += coder.narrow(own, right[0] | right[1], right[0], ends)
        factor = coder.widen(settled[t])
        np.multiply(low, 1 / _SMALL, out=full)
        np.floor(full, out=full)
        words[t], places[t] = full, place
        place += settled[t]
        full *= _SMALL * settled[t]
        low -= full
        low *= factor
    words[block] = np.ceil(low / _SMALL)
    places[block] = place
    counts = place + 1
    places += np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int32)
    flat[places[settled]] = words[settled]
    while (over := flat >> 24).any():
        flat &= (1 << 24) - 1
        flat[:-1] += over[1:]
    raw = np.ascontiguousarray(flat.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]).tobytes()
    ends = np.cumsum(3 * counts).tolist()
    return distinct, shares, [raw[b:e] for b, e in zip([0, *ends], ends, strict=False)]


def decode_blocks(distinct: np.ndarray, shares: np.ndarray, blocks: list[bytes], block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks, the last one's padding included."""
    lanes = len(blocks)
    of_slot = np.repeat(np.arange(len(distinct), dtype=np.uint16 if len(distinct) <= 1 << 16 else np.int32), shares)
    model, coder = _Model(lanes), _Coder(lanes, shares)
    # 24-bit words, and zeros behind each block's last; from the third on, the bits that follow the first 52.
    raw = np.frombuffer(b"".join(x for b in blocks for x in (b, bytes(12))), np.uint8).reshape(-1, 3).astype(np.int64)
    raw = raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]
    sizes = np.fromiter(map(len, blocks), np.int64, lanes) // 3 + 4
    place = np.cumsum(sizes) - sizes
    code = (raw[place] << 28 | raw[place + 1] << 4 | raw[place + 2] >> 20).astype(np.float64)
    words = np.zeros(len(raw))
    words[:-1] = (raw[:-1] & 0xFFFFF) << 4 | raw[1:] >> 20
    place += 2
    out = np.zeros((block, lanes), np.int32)
    rest, word, slot, own, small = np.empty(lanes), np.empty(lanes), np.empty(lanes, np.int64), np.empty(lanes, np.int64), np.empty(lanes, bool)
    for t in range(block):
        ends = coder.divide(model.predict())
        hit2, any_hit = code < ends
        np.subtract(code, ends[1], out=rest)
        # The quotient rounds to no other whole number, as both are below 2^53.
        rest /= coder.unit
        np.copyto(slot, rest, casting="unsafe")
        np.copyto(own, of_slot.take(slot, mode="clip"))
        entry = model.entry >> 4
        np.copyto(own, entry[1], where=any_hit)
        np.copyto(own, entry[0], where=hit2)
        model.learn(own)
        code -= coder.narrow(own, any_hit, hit2, ends)
        out[t] = own
        code *= coder.widen(small)
        words.take(place, out=word, mode="clip")
        word *= small
        code += word
        place += small
    return distinct[np.ascontiguousarray(out.T).ravel()]


def pack_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    distinct, shares, blocks = encode_blocks(ids, block)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], np.uint8)
    head = zlib.compress(
        b"".join(x.tobytes() for x in (np.diff(names, prepend=0).astype("<i8"), none, sizes.astype("<u8"), np.diff(distinct.astype(np.int64), prepend=0).astype("<u4"), shares.astype("<u4"))), 1
    )
    sums = struct.pack(f"<{len(blocks)}I", *map(zlib.crc32, blocks)) + struct.pack(f"<{len(blocks)}I", *map(len, blocks))
    fixed = struct.pack("<QQQII", len(doc_ids), len(distinct), len(head), len(blocks), block)
    return b"".join([MAGIC, struct.pack("<I", zlib.crc32(fixed + head + sums)), fixed, head, sums, *blocks])


def unpack_segment(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, numbers of tokens, and all ids; raises ChecksumError if anything has changed."""
    if body[:5] != MAGIC:
        raise ChecksumError("not a segment")
    (crc,) = struct.unpack_from("<I", body, 5)
    n_docs, n_ids, n_head, n_blocks, block = struct.unpack_from("<QQQII", body, 9)
    at = 9 + 32
    end = at + n_head + 8 * n_blocks
    if zlib.crc32(body[9:end]) != crc:
        raise ChecksumError("the segment's head has changed")
    head = zlib.decompress(body[at : at + n_head])
    parts, offset = [], 0
    for n, kind in ((n_docs, "<i8"), (n_docs, np.uint8), (n_docs, "<u8"), (n_ids, "<u4"), (n_ids, "<u4")):
        parts.append(np.frombuffer(head, kind, n, offset))
        offset += parts[-1].nbytes
    crcs = struct.unpack_from(f"<{n_blocks}I", body, at + n_head)
    lengths = struct.unpack_from(f"<{n_blocks}I", body, at + n_head + 4 * n_blocks)
    blocks, offset = [], end
    for k, n in enumerate(lengths):
        blocks.append(body[offset : offset + n])
        offset += n
        if zlib.crc32(blocks[-1]) != crcs[k]:
            raise ChecksumError(f"block {k} has changed")
    sizes = parts[2].astype(np.int64)
    ids = decode_blocks(np.cumsum(parts[3].astype(np.int64)), parts[4].astype(np.int64), blocks, block)
    names = np.cumsum(parts[0])
    return [None if none else int(d) for d, none in zip(names.tolist(), parts[1].tolist(), strict=True)], sizes, ids[: int(sizes.sum())]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, leading_space: bool = False, end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS, block: int = BLOCK) -> None:
    """Tokenises docs in ascending order of doc_id and writes segments below path."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = lean.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release("encoders")
        encode = common.encoder(tokenizer, leading_space).encode
        part, number, held, waiting = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal number
            names = [x for one in waiting for x in one[0]]
            sizes = np.concatenate([one[1] for one in waiting])
            ids = np.concatenate([one[2] for one in waiting])
            waiting.clear()
            number += 1
            row = [part, number, len(names), int(sizes.sum()), pack_segment(names, sizes, ids, block)]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["part", "number", "n_docs", "n_tokens", "body"])

        for batch in common.slices(batches, "text", 1 << 20):
            ids, counts = encode(batch.column("text").to_pylist())
            sizes = counts + 1
            whole, inner = np.full(int(sizes.sum()), end_id, np.uint32), np.ones(int(sizes.sum()), bool)
            inner[np.cumsum(sizes) - 1] = False
            whole[inner] = ids
            waiting.append((batch.column("doc_id").to_pylist(), sizes, whole))
            held += len(whole)
            if held >= segment_tokens:
                held = 0
                yield flush()
        if waiting:
            yield flush()

    ordered.mapInArrow(run, _SCHEMA).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (with_ids: and ids, 32-bit little-endian) of every document in the files."""
    segments = spark.read.schema(_SCHEMA).parquet(path)
    # One number for each part; the parts follow one another in the order of doc_id.
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip([p for p, _ in totals], np.cumsum([0] + [n for _, n in totals]).tolist(), strict=False))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    placed = segments.select("part", "number", "n_tokens").select("part", "number", F.coalesce(inside, F.lit(0)).alias("inside"))
    rows = segments.select("part", "number", "body").join(placed, ["part", "number"]).select("part", "inside", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, inside_, body in zip(*(batch.column(c) for c in ("part", "inside", "body")), strict=True):
                names, sizes, ids = unpack_segment(body.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                spans = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
                cols = [pa.array(names, pa.int64()), pa.array(ends - sizes + before[part.as_py()] + inside_.as_py()), pa.array(sizes), pa.array([zlib.crc32(raw[4 * b : 4 * e]) for b, e in spans], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(raw[4 * b : 4 * e]) for b, e in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.shared_path(spark, "tokens")
    write_tokens(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
