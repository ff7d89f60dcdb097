"""Packs documents into training sequences of equal estimated cost.

A piece of n tokens costs `linear` * n + `quadratic` * n^2, as attention stays within a piece. Documents are tokenised
and ended with `end_id`; whole sequences are cut off the front of long ones, and what is left over goes, in descending
order, to the sequence of lowest cost that has capacity, where a piece that doesn't fit is cut. As the sequences' capacities add up to
the tokens (the last ones have powers of two), every sequence is filled and nothing is padded.

Sequences are made in groups of about `group_tokens` tokens inside a partition, so nothing is shuffled and memory is
bounded. A document longer than a group is still one list of ids.

Defined cases: a null text counts as empty and gives its end id only; repeated rows are packed as often as they come; a
null doc_id stays null, and its pieces are packed like others; an empty table gives no rows; a very long text is cut into as many sequences as it fills. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 1024
GROUP_TOKENS = 2 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def capacities(tokens: int, length: int) -> list[int]:
    """Of the sequences that hold so many tokens without padding."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(sizes: np.ndarray, length: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, for documents of these sizes."""
    out: list[tuple[int, int, int, int, int]] = []
    used = 0
    rest: list[tuple[int, int, int]] = []
    for doc, size in enumerate(sizes.tolist()):
        full = size // length
        for k in range(full):
            out.append((doc, k * length, length, used + k, 0))
        used += full
        if size % length:
            rest.append((size % length, doc, full * length))
    room = capacities(sum(r[0] for r in rest), length)
    filled = [0] * len(room)
    heap = [(0.0, k) for k in range(len(room))]
    rest.sort(key=lambda r: (-r[0], r[1]))
    for size, doc, start in rest:
        while size:
            cost, k = heapq.heappop(heap)
            n = min(size, room[k] - filled[k])
            out.append((doc, start, n, used + k, filled[k]))
            filled[k] += n
            size, start = size - n, start + n
            if filled[k] < room[k]:
                heapq.heappush(heap, (cost + linear * n + quadratic * n * n, k))
    return out


def pack(docs: DataFrame, tokenizer: str, leading_space: bool = True, end_id: int = 0, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, with_ids: bool = False, pieces: int = common.PIECES) -> DataFrame:
    """A row for each piece; with_ids adds the ids as little-endian unsigned 32-bit integers. pieces: how many encoded pieces of
    text a worker keeps (it takes about 0.5 MB for 1,000)."""
    lean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release("encoders")
        encode = common.encoder(tokenizer, leading_space, pieces).encode
        base, held, waiting = TaskContext.get().partitionId() << 33, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal base
            names = [x for one in waiting for x in one[0]]
            ids = np.concatenate([one[1] for one in waiting])
            sizes = np.concatenate([one[2] for one in waiting])
            ends = np.cumsum(sizes)
            places = assign(sizes, length)
            waiting.clear()
            raw = memoryview(ids.tobytes())
            table = np.array(places, np.int64).reshape(-1, 5)
            first = (ends - sizes)[table[:, 0]] + table[:, 1]
            crcs = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(first.tolist(), (first + table[:, 2]).tolist(), strict=True)]
            rows = [pa.array([names[k] for k in table[:, 0].tolist()], pa.int64()), pa.array(table[:, 1]), pa.array(table[:, 2]), pa.array(crcs, pa.int64()), pa.array(sizes[table[:, 0]]), pa.array(table[:, 3] + base), pa.array(table[:, 4])]
            if with_ids:
                rows.append(pa.array([bytes(raw[4 * b : 4 * e]) for b, e in zip(first.tolist(), (first + table[:, 2]).tolist(), strict=True)], pa.binary()))
            base += int(table[:, 3].max()) + 1
            return pa.RecordBatch.from_arrays(rows, names=[*COLUMNS, *["ids"] * with_ids])

        for batch in common.slices(batches, "text", 1 << 20):
            ids, counts = encode(batch.column("text").to_pylist())
            sizes = counts + 1
            whole = np.full(int(sizes.sum()), end_id, "<u4")
            whole[common.ragged(np.cumsum(sizes) - sizes, counts)] = ids
            waiting.append((batch.column("doc_id").to_pylist(), whole, sizes))
            held += len(whole)
            if held >= group_tokens:
                held = 0
                yield flush()
        if waiting:
            yield flush()

    return lean.mapInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
