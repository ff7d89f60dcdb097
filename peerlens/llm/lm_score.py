"""Log-probability of whole documents from a lattice of subwords over word counts of the corpus.

The vocabulary of pieces is an existing one, read from a file. Its scores weigh the pieces, exp(score / T) each: they are
merge ranks of byte-pair encoding and no log-probabilities, so T brings them to the range that log-probabilities of so many
pieces have (the best and the last differ by the factor of the vocabulary's size). Expectation maximisation over all
distinct training words then counts the pieces; the vocabulary's weights stay in as a prior, worth `PRIOR` pieces for each
word. A word's probability sums over
all of its segmentations into pieces, by a forward recursion in logarithms; words that training has seen are further
arcs of the lattice that span a whole word, weighted by their counts less a discount. Each of the `CLASSES` - 1 most
frequent languages of the training documents has a set of counts; all later languages are pooled in one further set. A
document's probability sums over the sets, its own language unknown.

    L(w)    = stop * sum over segmentations of the product of the pieces' probabilities
    P(w)    = max(c - d, 0) / N + d * V / N * L(w)
    P_k(w)  = max(c_k - d, 0) / N_k + d * V_k / N_k * P(w)
    P(text) = sum over k of share_k * product over words and the end of P_k

The training documents are those with crc32(doc_id as text) mod 5 other than 1. Words are `[^\\x20\\x09-\\x0D]+` of the
text with A-Z lower-cased; each document ends with one end token.

Words that make up one in `HOT` of all training tokens or more (so there are at most that many, and they are sent to all
tasks) are scored where the document is; only the others are shuffled, as 64-bit hashes, to the table of words.

Defined cases: a null or empty text consists of the end only; a null doc_id counts as the empty text in the crc; repeated
rows are scored (and counted) each; without training documents only the pieces weigh in; an empty table gives no rows; a very long
text's words are counted in its row before they are joined. Columns but doc_id, text and lang are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HOT = 500_000
CLASSES = 6
ROUNDS = 2
PRIOR = 0.2
DISCOUNT = 0.5


class Lattice:
    """Pieces as byte strings (a word starts with a space) with log-probabilities, and the recursions over words."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray, stop: float, prior: np.ndarray | None = None):
        """prior: the vocabulary's own weights, which sum to 1 (none: all are alike)."""
        self.pieces, self.logp, self.stop = pieces, np.asarray(logp, np.float64), stop
        self.prior = np.full(len(pieces), 1 / len(pieces)) if prior is None else prior
        self.priced = np.append(self.logp, -np.inf)  # the last is what no piece has
        self.longest = max(map(len, pieces))
        keys = self._of(pieces)
        self.bits = max(12, int(np.ceil(np.log2(4 * len(pieces) + 1))))
        self.slot_key, self.slot_at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.deepest = 0
        for at, key in enumerate(keys.tolist()):
            slot, depth = key >> (64 - self.bits), 0
            while self.slot_at[slot] >= 0:
                slot, depth = (slot + 1) & ((1 << self.bits) - 1), depth + 1
            self.slot_key[slot], self.slot_at[slot] = key, at
            self.deepest = max(self.deepest, depth)

    @staticmethod
    def start(path: str) -> Lattice:
        """From a sentencepiece file; bytes, which have no score, weigh as much as the last piece."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        scores = [model.get_score(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
        best, last = max(scores), min(scores)
        seen: dict[bytes, float] = {bytes([b]): last for b in range(256)}
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
                continue
            raw = model.id_to_piece(k).lower().replace("▁", " ").encode()
            if raw and b" " not in raw[1:]:
                seen[raw] = max(model.get_score(k), seen.get(raw, -1e9))
        pieces = sorted(seen, key=lambda p: (-seen[p], p))
        weight = np.exp((np.array([seen[p] for p in pieces]) - best) * math.log(len(pieces)) / max(best - last, 1e-9))
        prior, stop = weight / weight.sum(), 0.2
        return Lattice(pieces, np.log(prior * (1 - stop)), math.log(stop), prior)

    @staticmethod
    def _of(strings: list[bytes]) -> np.ndarray:
        out = np.zeros(len(strings), np.uint64)
        for k, s in enumerate(strings):
            h = 0
            for b in s:
                h = (h * 0x9E3779B97F4A7C15 + b + 1) & 0xFFFFFFFFFFFFFFFF
            out[k] = h
        return common.mix64(out)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.slot_at[slot]
        # Only where another piece sits in the slot does the search go on.
        left = np.flatnonzero((at >= 0) & (self.slot_key[slot] != keys))
        at[left] = -1
        for k in range(1, self.deepest + 1):
            if not len(left):
                break
            near = (slot[left] + k) & ((1 << self.bits) - 1)
            there, same = self.slot_at[near], self.slot_key[near] == keys[left]
            at[left[same]] = there[same]
            left = left[(there >= 0) & ~same]
        return at

    def arcs(self, rows: np.ndarray) -> list[np.ndarray]:
        """rows: words of one length as a matrix of bytes. For each end j: a matrix of pieces (-1: none), by length."""
        n, size = rows.shape
        h = np.zeros((n, 0), np.uint64)
        out = []
        for j in range(size):
            # All strings that end at j: those that ended before, one byte longer, and the new byte alone.
            h = np.concatenate([np.zeros((n, 1), np.uint64), h[:, : self.longest - 1]], axis=1) * np.uint64(0x9E3779B97F4A7C15) + (rows[:, j : j + 1].astype(np.uint64) + np.uint64(1))
            out.append(self._find(common.mix64(h).ravel()).reshape(h.shape))
        return out

    def forward(self, rows: np.ndarray, arcs: list[np.ndarray]) -> np.ndarray:
        n, size = rows.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for j, found in enumerate(arcs, 1):
            # Column l of found is the piece of l + 1 bytes that ends at j and starts at j - 1 - l.
            before = alpha[:, j - found.shape[1] : j][:, ::-1]
            terms = self.priced[found] + before
            top = terms.max(axis=1)
            alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        return alpha

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of L(w)."""
        out = np.zeros(len(words))
        for at, rows in _by_length(words):
            out[at] = self.forward(rows, self.arcs(rows))[:, -1] + self.stop
        return out

    def expected(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """Expected uses of each piece over these words, each once."""
        counts = np.zeros(len(self.pieces))
        for _, rows in _by_length(words):
            arcs = self.arcs(rows)
            n, size = rows.shape
            alpha = self.forward(rows, arcs)
            beta = np.full((n, size + 1), -np.inf)
            beta[:, size] = 0
            whole = alpha[:, size]
            for j in range(size, 0, -1):
                found = arcs[j - 1]
                width = found.shape[1]
                step = self.priced[found] + beta[:, j][:, None]
                used = np.exp(step + alpha[:, j - width : j][:, ::-1] - whole[:, None])
                ok = found >= 0
                counts += np.bincount(found[ok], used[ok], len(self.pieces))
                start = beta[:, j - width : j][:, ::-1]
                beta[:, j - width : j] = np.logaddexp(start, step)[:, ::-1]
        return counts, len(words)

    def fitted(self, counts: np.ndarray, words: float) -> Lattice:
        smooth = counts + (PRIOR * words + 0.01) * self.prior
        total = smooth.sum() + words + 0.01
        return Lattice(self.pieces, np.log(smooth / total), math.log((words + 0.01) / total), self.prior)


def _by_length(words: list[bytes], limit: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the words (with a space before each) of one length, at most about `limit` bytes at a time."""
    if not words:
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size = int(sizes[order[b]]) + 1
        most = max(1, limit // size)
        for k in range(b, e, most):
            at = order[k : min(e, k + most)]
            yield at, np.frombuffer(b"".join(b" " + words[i] for i in at.tolist()), np.uint8).reshape(len(at), size)


def in_training() -> Column:
    return common.id_crc32() % 5 != 1


def _tokens(body: bytes) -> list[bytes]:
    return body.lower().split()


def _counts(docs: DataFrame, k: int) -> DataFrame:
    """word, and its training tokens in each class (0 if it is only in other documents)."""
    names = [f"c{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts = common.WordIndex(), np.zeros((1024, k), np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(index.index)
            for at in range(0, len(words), 100_000):
                part = words[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array(counts[at : at + len(part), i]) for i in range(k))], names=["word", *names])
            index.clear()
            counts[:] = 0

        for batch in common.slices(batches, "body", 2 << 20):
            if len(index.index) > 250_000:
                yield from flush()
            docs_ = [_tokens(b) for b in common.binary_list(batch.column("body"))]
            sizes = np.fromiter(map(len, docs_), np.int64, len(docs_))
            numbers = index.numbers([w for d in docs_ for w in d])
            if len(index.index) > len(counts):
                counts = np.concatenate([counts, np.zeros((max(len(counts), len(index.index) - len(counts)), k), np.int64)])
            kind = np.repeat(batch.column("kind").to_numpy(zero_copy_only=False), sizes)
            own = kind >= 0
            np.add.at(counts.reshape(-1), numbers[own] * k + kind[own], 1)
        yield from flush()

    rows = docs.select("body", "kind").mapInArrow(run, "word binary, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("word").agg(*[F.sum(n).alias(n) for n in names])


def _expected(words: DataFrame, lattice: Lattice) -> Lattice:
    sent = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(len(sent.value.pieces)), 0
        for batch in common.slices(common.gathered(batches), "word", 1 << 20):
            more, m = sent.value.expected(batch.column("word").to_pylist())
            counts, n = counts + more, n + m
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], float(n)))], names=["piece", "n"])

    # At most one row for each piece comes back.
    got = words.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros(len(lattice.pieces)), 0.0
    for r in got:
        if r["piece"] < 0:
            n = r["n"]
        else:
            counts[r["piece"]] = r["n"]
    return lattice.fitted(counts, n)


def lm_score(docs: DataFrame, vocabulary: str, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    lean = docs.select("doc_id", common.text_bytes().alias("body"), lang.alias("lang"), in_training().alias("train"))
    ends = lean.where("train").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect()
    all_ends = lean.where("train").count()
    kinds = {r["lang"]: i for i, r in enumerate(ends)}
    k = len(kinds) + 1
    pairs = [x for name, i in kinds.items() for x in (F.lit(name), F.lit(i))]
    number = F.coalesce(F.element_at(F.create_map(*pairs), F.col("lang")), F.lit(k - 1)) if pairs else F.lit(0)
    lean = lean.withColumn("kind", F.when(F.col("train"), number).otherwise(F.lit(-1)).cast("int"))
    counts = common.stored(_counts(lean, k), "words")

    cols = [f"c{i}" for i in range(k)]
    total_of = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    sums = counts.agg(*[F.sum(c).alias(f"n{i}") for i, c in enumerate(cols)], *[F.count_if(F.col(c) > 0).alias(f"v{i}") for i, c in enumerate(cols)], F.count_if(total_of > 0).alias("v")).first()
    end = [r["count"] for r in ends] + [all_ends - sum(r["count"] for r in ends)]
    n_k = [(sums[f"n{i}"] or 0) + end[i] for i in range(k)]
    v_k = [(sums[f"v{i}"] or 0) + (end[i] > 0) for i in range(k)]
    n_all, v_all = sum(n_k), (sums["v"] or 0) + (all_ends > 0)

    lattice = Lattice.start(vocabulary)
    for _ in range(rounds):
        lattice = _expected(counts.where(total_of > 0), lattice)

    sent = spark.sparkContext.broadcast(lattice)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = common.WordIndex(0)
        for batch in common.slices(common.gathered(batches), "word", 1 << 20):
            words = batch.column("word").to_pylist()
            hashes = np.fromiter(map(index.hash_of, words), np.uint64, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(hashes), pa.array(sent.value.score(words)), *(batch.column(c) for c in cols)], names=["word", "h", "lattice", *cols])

    priced = counts.mapInArrow(scored, "word binary, h long, lattice double, " + ", ".join(f"{c} long" for c in cols))

    def backed(c: Column, n: int, v: int, below: Column) -> Column:
        if not n:
            return below
        return F.greatest(c - F.lit(DISCOUNT), F.lit(0.0)) / F.lit(float(n)) + F.lit(DISCOUNT * v / n) * below

    total = total_of.alias("c")
    # A floor far below any share of counts, as exp() of a very long word's logarithm is nought.
    overall = F.greatest(backed(total_of, n_all, v_all, F.exp("lattice")), F.lit(1e-300))
    # Where that floor is reached the logarithm is what the lattice says.
    far = F.col("lattice") + F.lit(math.log(DISCOUNT * v_all / n_all) if n_all else 0.0)
    table = priced.select("word", "h", total, (total_of > 0).cast("long").alias("known"), F.log10(total_of + F.lit(0.5)).alias("base"), overall.alias("p"), far.alias("far"), *cols)
    logs = [
        F.when((F.col("c") == 0) & (F.col("far") < -600), (F.col("far") + F.lit(math.log(DISCOUNT * v_k[i] / n_k[i]) if n_k[i] else 0.0)) / F.lit(math.log(10)))
        .otherwise(F.log10(backed(F.col(c), n_k[i], v_k[i], F.col("p"))))
        .alias(f"s{i}")
        for i, c in enumerate(cols)
    ]
    table = common.stored(table.select("word", "h", "c", "known", "base", *logs), "priced")

    marks = [f"s{i}" for i in range(k)]
    top = table.where(F.col("c") >= max(1, -(-n_all // hot))).select("word", "base", *marks).collect()
    frequent = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)}, np.array([r[1:] for r in top], np.float64).reshape(len(top), k + 1)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_key, row = TaskContext.get().partitionId() << 33, 0
        near, values = frequent.value
        index = common.WordIndex(300_000)
        for batch in common.slices(batches, "body", 2 << 20):
            heads: list[list] = [[], [], []]
            keys, hashes, times = [], [], []
            sums_ = np.zeros((batch.num_rows, k + 1))
            for i, body in enumerate(common.binary_list(batch.column("body"))):
                words = _tokens(body)
                key = base_key + row
                row += 1
                at = np.fromiter((near.get(w, -1) for w in words), np.int64, len(words))
                known = at >= 0
                if known.any():
                    sums_[i] = values[at[known]].sum(axis=0)
                heads[0].append(key)
                heads[1].append(len(words) + 1)
                heads[2].append(int(known.sum()))
                rest = [words[j] for j in np.flatnonzero(~known).tolist()]
                if rest:
                    one, n = np.unique(index.hashed(rest), return_counts=True)
                    keys.append(np.full(len(one), key))
                    hashes.append(one.view(np.int64))
                    times.append(n)
            m = sum(map(len, keys))
            n = batch.num_rows
            head_hash = common.mix64(np.array(heads[0], np.uint64)).view(np.int64)
            none = pa.nulls(m, pa.int64())
            cols_ = [
                pa.concat_arrays([pa.array(heads[0], pa.int64()), pa.array(np.concatenate(keys) if m else np.zeros(0, np.int64))]),
                pa.concat_arrays([pa.array(head_hash), pa.array(np.concatenate(hashes) if m else np.zeros(0, np.int64))]),
                pa.concat_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.concatenate(times).astype(np.int64) if m else np.zeros(0, np.int64))]),
                pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), none]),
                pa.concat_arrays([batch.column("train"), pa.nulls(m, pa.bool_())]),
                pa.concat_arrays([pa.array(heads[1], pa.int64()), none]),
                pa.concat_arrays([pa.array(heads[2], pa.int64()), none]),
                *(pa.concat_arrays([pa.array(sums_[:, i].copy()), pa.nulls(m, pa.float64())]) for i in range(k + 1)),
            ]
            yield pa.RecordBatch.from_arrays(cols_, names=["key", "h", "times", "doc_id", "train", "n_tokens", "near", "near_base", *[f"near_{m_}" for m_ in marks]])

    schema = "key long, h long, times long, doc_id long, train boolean, n_tokens long, near long, near_base double, " + ", ".join(f"near_{m} double" for m in marks)
    rows = lean.select("doc_id", "body", "train").mapInArrow(spread, schema)
    joined = rows.join(table.select("h", "known", "base", *marks), "h", "left")

    def both(near: str, far: str) -> Column:
        return F.sum(F.coalesce(F.col(near), F.lit(0)) + F.when(F.col("times") > 0, F.col("times") * F.coalesce(F.col(far), F.lit(0))).otherwise(F.lit(0)))

    per = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("train").alias("train"),
        F.max("n_tokens").alias("n_tokens"),
        both("near", "known").cast("long").alias("n_known"),
        both("near_base", "base").alias("base"),
        *[both(f"near_{m}", m).alias(m) for m in marks],
    )
    share = [(end[i] + 0.5) / (all_ends + 0.5 * k) for i in range(k)]
    p_end = (max(all_ends - DISCOUNT, 0) / n_all if n_all else 0) or 0.5
    end_log = [math.log10(max(max(end[i] - DISCOUNT, 0) / n_k[i] + DISCOUNT * v_k[i] / n_k[i] * p_end, 1e-300)) if n_k[i] else math.log10(p_end) for i in range(k)]
    totals = [F.col(m) + F.lit(end_log[i] + math.log10(share[i])) for i, m in enumerate(marks)]
    most = F.greatest(*totals) if k > 1 else totals[0]
    score = most + F.log10(sum((F.pow(F.lit(10.0), t - most) for t in totals[1:]), F.pow(F.lit(10.0), totals[0] - most)))
    return per.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.lit(1 if all_ends else 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(math.log10(all_ends + 0.5)) - F.col("n_tokens") * F.lit(math.log10(n_all + 0.5 * (v_all + 1)))).alias("base_score"),
        score.alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_score(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
