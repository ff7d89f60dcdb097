"""Document quality from a linear-chain conditional random field over lines.

Each line has a hidden label, good or bad. Its features come from its own bytes and words and from those of the lines
before and after; neighbouring labels are tied by weights of their own. The forward-backward recursion gives every line's
probability of being good, and their mean, weighted by the lines' lengths, is the document's score.

Training takes the labelled documents whose crc32(doc_id as text) mod 4 isn't 2, at most `TRAIN_DOCUMENTS` of them (those
with the smallest hash of the id), and gives each line its document's label. Of several rows with one doc_id the text of
fewest lines, then the least one, is taken. In the order of doc_id, documents of at most `LONGEST` lines are taken until
`TRAIN_LINES` lines are full; longer ones aren't trained on (they are scored like all others). Only the lines' features of
these documents come to the driver. Labels, lang, source and doc_id are no features.

Defined cases: a null or empty text counts as one empty line; a document with several labels counts as good only if all
say so; without training rows every score is 0.5; with one class only, scores lean to it; repeated rows are scored each;
an empty table gives no rows. A very long text is scored whole, in arrays of its lines' features. Columns of the input that
are called like an added one are replaced, others pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TRAIN_DOCUMENTS = 8_000
TRAIN_LINES = 200_000
LONGEST = 20_000
THRESHOLD = 0.7

#: Kinds of bytes: 0 other signs, 1 small letters and bytes of non-ASCII letters, 2 capitals, 3 digits, 4 white space, 5 stops and commas, 6 symbols, 7 exclamation marks.
_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[0x20, 9, 10, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KIND[[ord(c) for c in "#*$%&|<>@^~=+_/\\{}[]"]] = 6
_KIND[ord("!")] = 7

_TABLE = common.mix64(np.arange(1, 257, dtype=np.uint64))
_POWER = common.mix64(np.arange(1000, 1000 + 4096, dtype=np.uint64)) | np.uint64(1)
OWN = 15


def line_features(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, their lengths in bytes, and the number of lines of each text."""
    buffer = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    counts = np.fromiter((b.count(b"\n") + 1 for b in bodies), np.int64, len(bodies))
    n = len(ends)
    line = np.repeat(np.arange(n), sizes + 1)
    kind = _KIND[buffer]
    kinds = np.bincount(line * 8 + kind, minlength=8 * n).reshape(n, 8).astype(np.float64)
    kinds[:, 4] -= 1  # the line's end
    inside = (kind != 4).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    w_start, w_end = edges[::2], edges[1::2]
    w_line = line[w_start] if len(w_start) else np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    where = np.arange(len(at)) - np.repeat(np.cumsum(w_end - w_start) - (w_end - w_start), w_end - w_start)
    hashes = np.add.reduceat(_TABLE[buffer[at]] * _POWER[where & 4095], np.cumsum(w_end - w_start) - (w_end - w_start)) if len(at) else np.zeros(0, np.uint64)
    words = np.bincount(w_line, minlength=n).astype(np.float64)
    next_same = (w_line[1:] == w_line[:-1]) & (hashes[1:] == hashes[:-1])
    same = np.bincount(w_line[1:][next_same], minlength=n)
    order = np.lexsort((hashes, w_line))
    new = np.ones(len(order), bool)
    new[1:] = (w_line[order][1:] != w_line[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(w_line[order][new], minlength=n)
    last = buffer[w_end - 1] if len(w_end) else np.zeros(0, np.uint8)
    odd_end = np.bincount(w_line, np.isin(_KIND[last], (6, 7)), minlength=n)
    alone = np.bincount(w_line, (w_end - w_start == 1) & (_KIND[buffer[w_start]] == 6), minlength=n) if len(w_start) else np.zeros(n)
    chars, w = np.maximum(sizes, 1), np.maximum(words, 1)
    closed = np.zeros(n)
    closed[sizes > 0] = buffer[ends[sizes > 0] - 1] == ord(".")
    out = np.stack(
        [
            np.ones(n),
            np.minimum(np.log1p(sizes) / 8, 2),
            np.minimum(np.log1p(words) / 6, 2),
            kinds[:, 2] / chars * 4,
            kinds[:, 3] / chars * 4,
            kinds[:, 5] / chars * 10,
            np.sqrt(kinds[:, 6] / chars) * 3,
            np.sqrt(kinds[:, 7] / chars) * 3,
            kinds[:, 0] / chars * 10,
            np.minimum(kinds[:, 1] / w / 8, 3),
            same / w * 2,
            distinct / w,
            odd_end / w * 2,
            alone / w * 3,
            closed,
        ],
        axis=1,
    )
    return out, sizes.astype(np.float64), counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and the line behind (zeros at a text's ends)."""
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    before[ends - counts] = 0
    behind[ends - 1] = 0
    return np.concatenate([own, before, behind], axis=1)


@dataclass
class Field:
    """weights: of the features, for good against bad. ties: [from, to] between labels of neighbouring lines."""

    weights: np.ndarray
    ties: np.ndarray

    def marginals(self, features: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(good) of every line; with pairs also the expected numbers of neighbours by labels, and the log-partition."""
        emit = np.zeros((len(features), 2))
        emit[:, 1] = features @ self.weights
        starts = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        starts, sizes = starts[order], counts[order]
        forward, back = np.zeros_like(emit), np.zeros_like(emit)
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t lines
        for t in range(longest):
            at = starts[: alive[t]] + t
            if not t:
                forward[at] = emit[at]
            else:
                x = forward[at - 1][:, :, None] + self.ties
                forward[at] = np.logaddexp(x[:, 0], x[:, 1]) + emit[at]
        for t in range(longest - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            x = (back[at + 1] + emit[at + 1])[:, None, :] + self.ties
            back[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        both = forward + back
        whole = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - whole)
        if not pairs:
            return good
        first = np.ones(len(features), bool)
        first[starts] = False
        at = np.flatnonzero(first)
        x = forward[at - 1][:, :, None] + self.ties + (back[at] + emit[at])[:, None, :] - whole[at][:, None, None]
        return good, np.exp(x).sum(axis=0), whole[starts].sum()


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, penalty: float = 1.0) -> Field:
    """Adam on the penalised log-likelihood; labels: of each line."""
    field = Field(np.zeros(features.shape[1]), np.zeros((2, 2)))
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2)
    n = max(1, len(counts))
    moments = [np.zeros(features.shape[1] + 4), np.zeros(features.shape[1] + 4)]
    for step in range(1, rounds + 1):
        good, pairs, _ = field.marginals(features, counts, pairs=True)
        grad = np.concatenate([features.T @ (labels - good) - penalty * field.weights, (seen - pairs).ravel() - penalty * field.ties.ravel()]) / n
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        change = 0.15 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        field = Field(field.weights + change[:-4], field.ties + change[-4:].reshape(2, 2))
    return field


def held_out():
    return common.id_crc32() % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where(~held_out())
    # The ids alone pick the sample, so no text is sorted.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
    body = common.text_bytes()
    lines = (F.length(body) - F.length(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit("")).cast("binary")) + 1).alias("n")
    found = docs.select("doc_id", lines, body.alias("body")).where(F.col("n") <= LONGEST).join(F.broadcast(chosen), "doc_id")
    # One row for each of the sample's ids, written, as its numbers of lines come to the driver first.
    lean = common.stored(found.groupBy("doc_id", "quality").agg(F.min(F.struct("n", "body")).alias("b")).select("doc_id", "quality", "b.n", "b.body"), "sample")
    taken, total = [], 0
    for r in lean.select("doc_id", "n").orderBy("doc_id").collect():
        if total + r["n"] <= TRAIN_LINES:
            taken.append(r["doc_id"])
            total += r["n"]
    if not taken:
        return None
    own_ids = docs.sparkSession.createDataFrame([(d,) for d in taken], T.StructType([docs.schema["doc_id"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "body", 1 << 20):
            own, _, counts = line_features(common.binary_list(batch.column("body")))
            ends = np.cumsum(counts)
            raw = [own[e - c : e].astype("<f4").tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality"), pa.array(counts), pa.array(raw, pa.binary())], names=["doc_id", "quality", "n", "raw"])

    found = lean.join(F.broadcast(own_ids), "doc_id").select("doc_id", "quality", "body").mapInArrow(run, "doc_id long, quality int, n long, raw binary")
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    counts = np.array([r["n"] for r in rows])
    own = np.frombuffer(b"".join(r["raw"] for r in rows), "<f4").reshape(-1, OWN).astype(np.float64)
    return fit(with_neighbours(own, counts), counts, np.repeat([r["quality"] for r in rows], counts).astype(np.int64))


ADDED = ("score", "predicted")


def classify(docs: DataFrame, field: Field | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    names = [c for c in docs.columns if c not in ADDED]
    raw = common.fresh([*docs.columns, *ADDED], "body")
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in common.slices(batches, raw, 1 << 20):
            own, sizes, counts = line_features(common.binary_list(batch.column(raw)))
            if field is None:
                score = np.full(len(counts), 0.5)
            else:
                good = field.marginals(with_neighbours(own, counts), counts)
                weight = np.maximum(sizes, 1)
                starts = np.cumsum(counts) - counts
                score = np.clip(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 0, 1)
            added = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names=[*names, *ADDED])

    return docs.select(*[f"`{c}`" for c in names], common.text_bytes(f"`{text}`").alias(raw)).mapInArrow(run, schema)


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, common.table(spark, sf_dir, "labels"))
    lean = docs.select("doc_id", held_out().alias("held_out"), "text")
    return classify(lean, field).drop("text")
