"""Packs documents into as few training sequences as it can, by linear grouping.

Documents are tokenised and ended with `end_id`; only those longer than a sequence are cut, into pieces of which all but
the first have full length. What is packed are then lengths, and there are at most `length` different ones: the driver
sees how many pieces have each length, nothing else. From these counts it makes a plan:

1. Large lengths, in descending order, fall into groups of equal cardinality; each is rounded up to its group's largest.
2. The few rounded sizes are packed by configurations (which sizes share a sequence): a linear program over all
   configurations, solved by column generation with a knapsack, whose solution (or a share of it) is rounded down.
3. Actual pieces take the places of their groups, in descending order, so it is known how full every sequence is; the
   smallest place of each stays open.
4. Pieces that are left, and all small ones, go by best fit, in descending order, to the fullest sequence with room.

The plan with the fewest sequences among a few shares is taken.

As pieces of one length are alike, a step of the plan deals a run of them to a run of sequences; the plan's size depends on
the number of lengths, not of pieces. Pieces number themselves within their length: each task counts its own, and a
window over the counts of tasks gives where each task's numbers start. Place and sequence follow from length and number.

Defined cases: a null text counts as empty and gives its end id only; repeated rows are packed as often as they come; a
null doc_id stays null; an empty table gives no rows; a very long text gives a piece for each sequence that it fills. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LENGTH = 1024
#: Pieces longer than this part of a sequence are large; their lengths fall into so many groups.
LARGE, GROUPS = 1 / 8, 96
#: Parts of the linear program's solution that plans try.
SHARES = (1.0, 0.5, 0.25, 0.125)
#: Columns that the linear program may take in at most; its solution is feasible whenever it stops.
COLUMNS_MOST = 4000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, pos long"
#: A step of the plan: pieces first to behind (by number) of one length; the k-th of them is the (skip + k)-th of those that
#: are dealt, `each` to a sequence, from `sequence` on; the first of a sequence lies at `offset`.
_STEP = np.dtype([("length", "i8"), ("first", "i8"), ("behind", "i8"), ("skip", "i8"), ("sequence", "i8"), ("each", "i8"), ("offset", "i8")])


class Groups:
    """Large lengths in descending order, by rank, in groups of equal cardinality; a group's size is its largest length."""

    def __init__(self, counts: np.ndarray, length: int, large: float = LARGE, groups: int = GROUPS):
        self.lengths = [s for s in range(length - 1, int(length * large), -1) if counts[s]]
        self.behind = np.cumsum([counts[s] for s in self.lengths], dtype=np.int64)  # rank behind each length's last piece
        total = int(self.behind[-1]) if self.lengths else 0
        edges = [0, *self.behind.tolist()] if len(self.lengths) <= groups else [*range(0, total, -(-total // groups)), total]
        self.sizes: list[int] = []
        self.demand: list[int] = []
        self.at: list[int] = []
        for b, e in zip(edges, edges[1:], strict=False):
            size = self.lengths[int(np.searchsorted(self.behind, b, side="right"))]
            if self.sizes and self.sizes[-1] == size:
                self.demand[-1] += e - b
            else:
                self.sizes.append(size)
                self.demand.append(e - b)
                self.at.append(b)


def _knapsack(sizes: list[int], worth: np.ndarray, length: int) -> np.ndarray:
    """How often each size is taken in the configuration of greatest worth."""
    best = np.zeros(length + 1)
    steps = [g for g in np.argsort(-worth / sizes).tolist() if worth[g] > 1e-12 for _ in range(length // sizes[g])]
    taken = np.zeros((len(steps), length + 1), bool)
    for k, g in enumerate(steps):
        s = sizes[g]
        other = best[: length + 1 - s] + worth[g]
        better = other > best[s:] + 1e-12
        taken[k, s:] = better
        best[s:] = np.where(better, other, best[s:])
    out, room = np.zeros(len(sizes), np.int64), length
    for k in reversed(range(len(steps))):
        if taken[k, room]:
            out[steps[k]] += 1
            room -= sizes[steps[k]]
    return out


def configurations(sizes: list[int], demand: list[int], length: int, most: int = COLUMNS_MOST) -> list[tuple[float, np.ndarray]]:
    """(how many sequences, how many of each size in one): a solution of the linear program."""
    n = len(sizes)
    if not n:
        return []
    columns = [np.eye(n, dtype=np.int64)[g] * (length // s) for g, s in enumerate(sizes)]
    want = np.array(demand, float)
    inverse = np.diag([1.0 / c[g] for g, c in enumerate(columns)])
    x = inverse @ want
    for turn in range(most):
        column = _knapsack(sizes, inverse.sum(axis=0), length)
        if inverse.sum(axis=0) @ column <= 1 + 1e-7:
            break
        along = inverse @ column
        ratio = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[out] = column
        row = inverse[out] / along[out]
        inverse -= np.outer(along, row)
        inverse[out] = row
        if turn % 64 == 63:
            inverse = np.linalg.inv(np.array(columns, float).T)
        x = np.maximum(inverse @ want, 0)
    return list(zip(x.tolist(), columns, strict=True))


class Plan:
    """Where the pieces go, from how many there are of each length (counts[s] for s up to length)."""

    def __init__(self, counts: np.ndarray, length: int, configured: list[tuple[float, np.ndarray]], groups: Groups, share: float = 1.0):
        self.counts, self.length, self.sequences = counts.astype(np.int64), length, 0
        self.steps: list[tuple[int, int, int, int, int, int, int]] = []
        #: By free room: runs of sequences (first, how many).
        self.free: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
        #: By length: runs of piece numbers (first, behind) that have no place yet.
        self.waiting: list[list[tuple[int, int]]] = [[(0, int(n))] if n else [] for n in self.counts]
        self._grouped(configured, groups, share)
        self._best_fit()
        self.used = self.sequences - sum(n for _, n in self.free[length])
        table = np.array(sorted(self.steps), np.int64).reshape(-1, 7)
        self.table = {name: np.ascontiguousarray(table[:, k]) for k, name in enumerate(_STEP.names)}

    def _grouped(self, configured: list[tuple[float, np.ndarray]], groups: Groups, share: float) -> None:
        used = [0] * len(groups.sizes)
        for x, column in configured:
            n, column = int(x * share + 1e-6), column.copy()
            # The smallest place stays open: best fit finds the piece that fills it.
            column[np.flatnonzero(column)[-1]] -= 1
            slots = []  # first rank of the group's pieces here, how many in a sequence, rank behind its last piece
            for g in np.flatnonzero(column).tolist() if n else ():
                slots.append((groups.at[g] + used[g], int(column[g]), groups.at[g] + groups.demand[g]))
                used[g] = min(groups.demand[g], used[g] + n * int(column[g]))
            if slots:
                self._configured(n, slots, groups.lengths, groups.behind)

    def _configured(self, n: int, slots: list[tuple[int, int, int]], lengths: list[int], behind: np.ndarray) -> None:
        """Deals actual pieces to n sequences. Between two edges all sequences hold pieces of the same lengths."""
        edges = {0, n}
        for first, each, end in slots:
            for rank in [*behind[(behind > first) & (behind < first + n * each)].tolist(), end]:
                edges |= {e for e in ((rank - first) // each, -(-(rank - first) // each)) if 0 < e < n}
        before = dict(zip(lengths, (behind - [self.counts[s] for s in lengths]).tolist(), strict=True))
        order = sorted(edges)
        for b, e in zip(order, order[1:], strict=False):
            offset = 0
            for first, each, end in slots:
                k = 0
                while k < each and first + b * each + k < end:
                    rank = first + b * each + k
                    place = int(np.searchsorted(behind, rank, side="right"))
                    s = lengths[place]
                    # One sequence may hold two lengths of a group; a run of sequences has one.
                    alike = min(each - k, int(behind[place]) - rank, end - rank) if e - b == 1 else each
                    number = rank - before[s]
                    self._deal(s, number, number + (e - b) * alike, 0, self.sequences + b, alike, offset)
                    offset += s * alike
                    k += alike
            self.free[self.length - offset].append((self.sequences + b, e - b))
        self.sequences += n

    def _deal(self, s: int, first: int, behind: int, skip: int, sequence: int, each: int, offset: int) -> None:
        self.steps.append((s, first, behind, skip, sequence, each, offset))
        left = []
        for b, e in self.waiting[s]:
            left += [(x, y) for x, y in ((b, min(e, first)), (max(b, behind), e)) if x < y]
        self.waiting[s] = left

    def _take(self, s: int, n: int, sequence: int, each: int, offset: int) -> None:
        """Deals the next n waiting pieces of length s."""
        skip = 0
        while skip < n:
            b, e = self.waiting[s][0]
            e = min(e, b + n - skip)
            self._deal(s, b, e, skip, sequence, each, offset)
            skip += e - b

    def _best_fit(self) -> None:
        for s in range(self.length, 0, -1):
            left = sum(e - b for b, e in self.waiting[s])
            for room in range(s, self.length + 1):
                while left and self.free[room]:
                    first, n = self.free[room].pop()
                    left -= self._fill(s, left, first, n, room)
            if left:
                first, n = self.sequences, -(-left // (self.length // s))
                self.sequences += n
                self._fill(s, left, first, n, self.length)

    def _fill(self, s: int, left: int, first: int, n: int, room: int) -> int:
        """Puts up to `left` pieces into n sequences with equal room, as many as fit in each; says how many."""
        each = room // s
        whole = min(n, left // each)
        if whole:
            self._take(s, whole * each, first, each, self.length - room)
            self.free[room - each * s].append((first, whole))
        rest = min(left - whole * each, each) if whole < n else 0
        if rest:
            self._take(s, rest, first + whole, rest, self.length - room)
            self.free[room - rest * s].append((first + whole, 1))
        if whole + bool(rest) < n:
            self.free[room].append((first + whole + bool(rest), n - whole - bool(rest)))
        return whole * each + rest

    def places(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number."""
        t = self.table
        span = int(self.counts.max()) + 1
        k = np.searchsorted(t["length"] * span + t["first"], lengths * span + numbers, side="right") - 1
        at = numbers - t["first"][k] + t["skip"][k]
        return t["sequence"][k] + at // t["each"][k], t["offset"][k] + at % t["each"][k] * lengths


def best_plan(counts: np.ndarray, length: int) -> Plan:
    """Of the plans that follow several shares of the linear program's solution, the one with the fewest sequences: rounding up
    costs room, and how much of it small pieces fill again depends on how many there are."""
    groups = Groups(counts, length)
    configured = configurations(groups.sizes, groups.demand, length)
    return min((Plan(counts, length, configured, groups, share) for share in SHARES), key=lambda p: p.used)


def cut(docs: DataFrame, tokenizer: str, leading_space: bool = True, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents; pos numbers a part's pieces of one length."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release("encoders")
        encode = common.encoder(tokenizer, leading_space).encode
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in common.slices(batches, "text", 1 << 20):
            ids, counts = encode(batch.column("text").to_pylist())
            sizes = counts + 1
            whole = np.full(int(sizes.sum()), end_id, "<u4")
            whole[common.ragged(np.cumsum(sizes) - sizes, counts)] = ids
            raw = memoryview(whole.tobytes())
            n = -(-sizes // length)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = common.ragged(np.zeros(len(n)), n)
            front = (sizes - (n - 1) * length)[doc]
            start = np.where(piece > 0, front + (piece - 1) * length, 0)
            size = np.where(piece > 0, length, front)
            at = (np.cumsum(sizes) - sizes)[doc] + start
            crcs = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(at.tolist(), (at + size).tolist(), strict=True)]
            order = np.argsort(size, kind="stable")
            run_ = size[order]
            pos = np.empty(len(size), np.int64)
            pos[order] = np.arange(len(size)) - np.searchsorted(run_, run_) + seen[run_]
            seen += np.bincount(size, minlength=length + 1)
            rows = [batch.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), start, size, crcs, np.full(len(size), part, np.int32), pos]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([r if isinstance(r, pa.Array) else pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=names)

    return lean.mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer: str, leading_space: bool = True, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    pieces = common.stored(cut(docs, tokenizer, leading_space, end_id, length), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(length + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        counts[r["length"]] = r["n"]
    plan = docs.sparkSession.sparkContext.broadcast(best_plan(counts, length))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(counted.select("part", "length", before.alias("before")), ["part", "length"])
    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("pos")).alias("number"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.gathered(batches):
            sequence, offset = plan.value.places(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
