"""Similarity self-join of documents by the Jaccard coefficient of their word n-grams, with all links' components.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (of the whole sequence, if shorter). Documents
with equal sets form one class from the start. Two bounds that follow from the sizes then discard classes that cannot
link to any other, without looking at pairs:

1. If sets of n and m elements link, they share ceil(3/4 max(n, m)) at least, so the first n - ceil(3n/4) + L elements in
   any common order share L; a class whose prefix has fewer elements that occur elsewhere than any partner would need is
   out. Prefixes are dealt by element.
2. Of all its elements, at least ceil(3n/4) must occur in other classes that are left.

What is left is linked into candidate groups by shared elements of the shortest prefix. Groups are dealt into blocks of
about `BLOCK` classes (a large group into several by bands of sizes; each pair of neighbouring bands' blocks, whose sets may
be near enough in size to link, meets in a task of its own), and a block's document
by n-gram incidence matrix is multiplied with the other's transpose, column block by column block, which accumulates
all overlap counts; pairs below the bound are discarded, and a spanning forest of the links is kept. No step is
approximate (up to hash collisions) and none has a cap.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; equal sets link;
repeated rows are documents of one class; a null doc_id takes part, but is no component_id unless alone; an empty table
gives no rows; a very long text's set is one row of eight bytes for each shingle. Other columns are ignored by
`ngram_components` and kept, whatever their names, by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
BLOCK = 1024
COLUMNS = 4096
#: Bits for each class, and at least, of the map that tells which classes are still in; what it lets through by mistake, one
#: in so many at most, the next step finds.
BITS_A_CLASS, LEAST_BITS = 16, 1 << 22
#: Counters of elements, at least and at most, for an order that puts frequent ones last; any order is right, but where many
#: elements share a counter, frequent ones don't stand out.
CELLS, MOST_CELLS = 1 << 20, 1 << 23
#: Bytes of sets that a round of block products may send whatever there is; beyond, it sends all sets twice at most.
ROUND = 1 << 28
PARTS = 64
_FACTORS = [np.uint64(x) for x in common.mix64(np.arange(71, 71 + SHINGLE, dtype=np.uint64)) | np.uint64(1)]
_SHORT = common.mix64(np.arange(91, 91 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_ENTRY = np.dtype([("token", "<u8"), ("key", "<i8")])
#: For the bounds 32 bits of an element do, besides its bucket: where two elements look alike, more classes stay in.
_SHORT_ENTRY = np.dtype([("token", "<u4"), ("key", "<i8")])

_U32 = np.uint64(32)
_words = None


def sets_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and their numbers."""
    global _words
    if _words is None:
        _words = common.WordIndex(300_000)
        common.held["words"] = _words.clear
    lists = [b.lower().split() for b in bodies]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = _words.hashed([w for one in lists for w in one])
    ends = np.cumsum(sizes)
    full = np.maximum(sizes - SHINGLE + 1, 0)
    start = common.ragged(ends - sizes, full)
    h = np.zeros(len(start), np.uint64)
    for k, factor in enumerate(_FACTORS):
        h += flat[start + k] * factor
    doc = np.repeat(np.arange(len(lists)), full)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    rest = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short.tolist()):
        own = flat[ends[d] - sizes[d] : ends[d]]
        rest[i] = (own * _SHORT[: len(own)]).sum() ^ _SHORT[len(own)]
    if len(short):
        # A short text's one element goes where its place is among the others.
        place = np.searchsorted(doc, short)
        h, doc = np.insert(h, place, rest), np.insert(doc, place, short)
    h = common.mix64(h)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(lists)))]).tolist()
    for b, e in zip(bounds[:-1], bounds[1:], strict=True):
        h[b:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(lists))


def keys_of(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(common.mix64(h ^ np.uint64(0x5851F42D4C957F2D)), starts) + counts[some].astype(np.uint64)
    return common.mix64(out).view(np.int64)


def need(n: np.ndarray) -> np.ndarray:
    """Elements that a set of n shares with any partner at least: ceil(3n/4)."""
    return (3 * n + 3) // 4


def band_of(n: Column) -> Column:
    """The band of sizes: sets that link have neighbouring bands at most, as neither is over 4/3 of the other (and a bit,
    for what doubles round)."""
    return F.floor(F.log(n) / F.lit(1.0001 * math.log(4 / 3))).cast("int")


def _lead(n: np.ndarray) -> np.ndarray:
    return n // 8 + 1


def _bucketed(tokens: np.ndarray, keys: np.ndarray, buckets: int, kind: np.dtype) -> Iterator[tuple[int, bytes]]:
    entries = np.empty(len(tokens), kind)
    entries["token"], entries["key"] = tokens >> _U32 if kind is _SHORT_ENTRY else tokens, keys
    own = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    bounds = np.flatnonzero(np.diff(own[order], prepend=-1, append=-1))
    entries, own = entries[order], own[order]
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(own[b]), entries[b:e].tobytes()


#: Stands for classes that were counted where they were found.
_COUNTED = np.iinfo(np.int64).min


def _sorted_distinct(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
    return tokens[new], keys[new]


def _firsts(tokens: np.ndarray) -> np.ndarray:
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    return first


def fold_to_stars(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """One entry of each token, with the smallest class, and the pairs that tie the others to it. So a token that very many
    classes have is one entry of each batch."""
    tokens, keys = _sorted_distinct(tokens, keys)
    first = _firsts(tokens)
    lowest = keys[np.flatnonzero(first)][np.cumsum(first) - 1] if len(keys) else keys
    pairs = np.unique(np.stack([keys[~first], lowest[~first]], axis=1), axis=0) if (~first).any() else np.zeros((0, 2), np.int64)
    return tokens[first], keys[first], [(-1 - int(abs(pairs[0, 0]) % 1024), np.ascontiguousarray(pairs, "<i8").tobytes())] if len(pairs) else []


def fold_to_counts(parts: int):
    """Classes that share a token within the batch are counted at once, and one entry without a class goes on for it. A
    class whose copies lie in several tasks may be counted more than once, so a bound may let more through, never less."""

    def run(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        tokens, keys = _sorted_distinct(tokens, keys)
        shared = _shared(tokens)
        marks = tokens[shared & _firsts(tokens)]
        counted = [(-1 - part, raw) for part, raw in _packed_counts(keys[shared], parts)]
        return np.concatenate([tokens[~shared], marks]), np.concatenate([keys[~shared], np.full(len(marks), _COUNTED)]), counted

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def _postings(rows: DataFrame, buckets: int, prefix, kind: np.dtype, fold, often=None) -> DataFrame:
    """From documents (body) or sets (key, raw): bucket and raw entries of the first prefix(n) elements of each class, by
    hash, or by what often (a broadcast array of counters) holds and then by hash. fold takes out of a batch what can be told
    there; its results have negative buckets."""
    has_sets = "raw" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release("words")
        seen: set[int] = set()
        for batch in common.slices(batches, "raw" if has_sets else "body", 2 << 20):
            if has_sets:
                raws = common.binary_list(batch.column("raw"))
                h = np.frombuffer(b"".join(raws), np.uint64)
                counts = np.fromiter((len(r) // 8 for r in raws), np.int64, len(raws))
                keys = batch.column("key").to_numpy()
            else:
                h, counts = sets_of(common.binary_list(batch.column("body")))
                keys = keys_of(h, counts)
            first = np.zeros(len(keys), bool)
            for i, key in enumerate(keys.tolist()):
                if key not in seen and counts[i]:
                    first[i] = True
                    seen.add(key)
            if len(seen) > 2_000_000:
                seen.clear()
            starts = np.cumsum(counts) - counts
            if often is not None:
                rank = often.value[(h % np.uint64(len(often.value))).astype(np.int64)]
                h = h[np.lexsort((h, rank, np.repeat(np.arange(len(counts)), counts)))]
            lengths = np.minimum(prefix(counts), counts) * first
            at = common.ragged(starts, lengths)
            tokens, own, told = fold(h[at], np.repeat(keys, lengths))
            yield _batch([*_bucketed(tokens, own, buckets, kind), *told], ["bucket", "raw"], [pa.int32(), pa.binary()])

    return rows.mapInArrow(run, "bucket int, raw binary")


def _gathered(postings: DataFrame, buckets: int, each, schema: str, kind: np.dtype, told=None) -> DataFrame:
    """Applies each(entries, sorted by token and key, distinct) to what a partition has of its buckets, and told to the
    results that came with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                if bucket < 0:
                    yield told(-1 - bucket, raw)
                else:
                    held.setdefault(bucket, []).append(raw)
        for bucket in list(held):
            entries = np.frombuffer(b"".join(held.pop(bucket)), kind)
            yield from each(*_sorted_distinct(entries["token"], entries["key"]))

    return postings.repartition(buckets, "bucket").mapInArrow(run, schema)


def _shared(token: np.ndarray) -> np.ndarray:
    """Which entries have a token that another class has, too."""
    same = token[1:] == token[:-1]
    out = np.zeros(len(token), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


_COUNT = np.dtype([("key", "<i8"), ("n", "<i8")])


def _counter(parts: int):
    """Counts of each class's shared elements, packed by a part of the classes: a row for each part, not for each class."""

    def run(token: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _batch(list(_packed_counts(key[_shared(token) & (key != _COUNTED)], parts)), ["part", "raw"], [pa.int32(), pa.binary()])

    return run


def _packed_counts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """How often each key is there, packed by part."""
    keys, n = np.unique(keys, return_counts=True)
    own = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    packed = np.empty(len(keys), _COUNT)
    packed["key"], packed["n"] = keys[order], n[order]
    own = own[order]
    bounds = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield int(own[b]), packed[b:e].tobytes()


def _part_row(part: int, raw: bytes) -> pa.RecordBatch:
    return _batch([(part, raw)], ["part", "raw"], [pa.int32(), pa.binary()])


def _pair_rows(_: int, raw: bytes) -> pa.RecordBatch:
    pairs = np.frombuffer(raw, "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _summed(counts: DataFrame, parts: int) -> DataFrame:
    """key, n_shared from packed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [raw for batch in batches for raw in batch.column("raw").to_pylist()]
        every = np.frombuffer(b"".join(held), _COUNT)
        keys, at = np.unique(every["key"], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, every["n"], len(keys)).astype(np.int64))], names=["key", "n_shared"])

    return counts.repartition(parts, "part").mapInArrow(run, "key long, n_shared long")


def _stars(token: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of the classes that have a token: each with the smallest."""
    if not len(token):
        return
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    lowest = key[np.flatnonzero(first)][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([key[~first], lowest[~first]], axis=1), axis=0) if (~first).any() else np.zeros((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _reduced(arrays: DataFrame, size: int, kind, together) -> np.ndarray:
    """One array of fixed size from the parts (part, raw) that tasks have made of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                one = np.frombuffer(raw, kind)
                held[part] = together(held[part], one) if part in held else one
        yield _batch([(p, x.tobytes()) for p, x in held.items()], ["part", "raw"], [pa.int32(), pa.binary()])

    out = np.zeros((PARTS, size // PARTS), kind)
    with common.passing(arrays.sparkSession):
        for r in arrays.repartition(PARTS, "part").mapInArrow(run, "part int, raw binary").collect():
            out[r["part"]] = np.frombuffer(r["raw"], kind)
    return out.reshape(-1)


def _parts(array: np.ndarray) -> pa.RecordBatch:
    rows = array.reshape(PARTS, -1)
    return _batch([(i, rows[i].tobytes()) for i in range(PARTS) if rows[i].any()], ["part", "raw"], [pa.int32(), pa.binary()])


def map_bits(classes: int) -> int:
    """The bits of a map for so many classes, a power of two."""
    return max(LEAST_BITS, 1 << (BITS_A_CLASS * classes - 1).bit_length()) if classes else LEAST_BITS


def _bitmap(keys: DataFrame, size: int) -> np.ndarray:
    """A packed map of `size` bits with those of all keys set. Keys are dealt by their place, so each task makes a piece."""
    each = size // PARTS
    placed = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("place")).withColumn("part", (F.col("place") / each).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, place = batch.column("part").to_numpy(), batch.column("place").to_numpy()
            for p in np.unique(part).tolist():
                at = place[part == p] - p * each
                bits = held.setdefault(p, np.zeros(each // 8, np.uint8))
                np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield _batch([(p, x.tobytes()) for p, x in held.items()], ["part", "raw"], [pa.int32(), pa.binary()])

    out = np.zeros((PARTS, each // 8), np.uint8)
    with common.passing(keys.sparkSession):
        for r in placed.repartition(PARTS, "part").mapInArrow(run, "part int, raw binary").collect():
            out[r["part"]] = np.frombuffer(r["raw"], np.uint8)
    return out.reshape(-1)


def cells_for(elements: int) -> int:
    """How many counters so many elements get: a power of two, one for about eight of them."""
    return min(MOST_CELLS, max(CELLS, 1 << (elements // 8).bit_length()))


def _frequencies(sets: DataFrame, size: int) -> np.ndarray:
    """So many counters of the sets' elements, of 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.uint32)
        for batch in common.slices(batches, "raw"):
            h = np.frombuffer(b"".join(common.binary_list(batch.column("raw"))), np.uint64)
            at, n = np.unique((h % np.uint64(size)).astype(np.int64), return_counts=True)
            cells[at] += n.astype(np.uint32)
        yield _parts(cells)

    counted = _reduced(sets.select("raw").mapInArrow(run, "part int, raw binary"), size, np.uint32, np.add)
    return np.minimum(counted, np.iinfo(np.uint16).max).astype(np.uint16)


def _product(x_sets: list[np.ndarray], y_sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all x with all y: incidence matrices multiplied in blocks of columns."""
    flat_x, flat_y = np.concatenate(x_sets), np.concatenate(y_sets)
    doc_x, doc_y = (np.repeat(np.arange(len(s)), [len(a) for a in s]) for s in (x_sets, y_sets))
    both = np.intersect1d(flat_x, flat_y)
    at_x, at_y = np.searchsorted(both, flat_x), np.searchsorted(both, flat_y)
    in_x, in_y = (both[np.minimum(a, len(both) - 1)] == f if len(both) else np.zeros(len(f), bool) for a, f in ((at_x, flat_x), (at_y, flat_y)))
    counts = np.zeros((len(x_sets), len(y_sets)), np.float32)
    col_x, col_y, doc_x, doc_y = at_x[in_x], at_y[in_y], doc_x[in_x], doc_y[in_y]
    order_x, order_y = np.argsort(col_x, kind="stable"), np.argsort(col_y, kind="stable")
    col_x, doc_x, col_y, doc_y = col_x[order_x], doc_x[order_x], col_y[order_y], doc_y[order_y]
    for b in range(0, len(both), COLUMNS):
        sides = []
        for col, doc, n in ((col_x, doc_x, len(x_sets)), (col_y, doc_y, len(y_sets))):
            lo, hi = np.searchsorted(col, (b, b + COLUMNS))
            side = np.zeros((n, min(COLUMNS, len(both) - b)), np.float32)
            side[doc[lo:hi], col[lo:hi] - b] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    return counts


def _forest(links: np.ndarray, x_keys: np.ndarray, y_keys: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links (x by y) join."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for i, j in np.argwhere(links).tolist():
        a, b = int(x_keys[i]), int(y_keys[j])
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition: group, i, j (blocks that meet), side (0: of block i, 1: of block j), key, raw."""
    common.release()
    held: dict[tuple, tuple[dict[int, bytes], dict[int, bytes]]] = {}
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("group", "i", "j", "side", "key", "raw")]
        for group, i, j, side, key, raw in zip(*cols, strict=True):
            held.setdefault((group, i, j), ({}, {}))[side][key] = raw
    for (_, i, j), (x, y) in held.items():
        y = x if i == j else y
        if not x or not y:
            continue
        x_keys, y_keys = (np.array(list(s), np.int64) for s in (x, y))
        x_sets, y_sets = ([np.frombuffer(r, np.uint64) for r in s.values()] for s in (x, y))
        overlap = _product(x_sets, y_sets)
        n, m = (np.array([len(a) for a in s], np.float64) for s in (x_sets, y_sets))
        links = 175 * overlap.astype(np.float64) >= 75 * (n[:, None] + m[None, :])
        links &= x_keys[:, None] != y_keys[None, :]
        edges = _forest(np.triu(links) if i == j else links, x_keys, y_keys)
        yield _batch(edges, ["a", "b"], [pa.int64(), pa.int64()])


def _only(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(known) - 1)
    return (known[at >> 3] << (at & 7).astype(np.uint8) & 128) > 0


def rounds_for(sent: int | None, once: int | None) -> int:
    """In how many rounds blocks meet, so that what a round sends (of `sent` bytes in all) is bounded by the sets' own bytes."""
    return max(1, -(-(sent or 0) // max(ROUND, 2 * (once or 0))))


def links(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """a, b: a spanning forest of the links between classes of equal sets; and the tables that can be removed when it has
    been read. classes: key and n of all of them."""
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(8, buckets // 8)
    lean = docs.select(common.text_bytes().alias("body"))
    with common.passing(spark):
        bits = map_bits(classes.count())

    def those_with(counts: DataFrame, least):
        """A map of the classes whose counted elements are enough."""
        enough = _summed(counts, parts).join(classes, "key").where(F.col("n_shared") >= least)
        return spark.sparkContext.broadcast(_bitmap(enough, bits))

    # The first bound.
    led = _gathered(_postings(lean, buckets, lambda n: n - need(n) + _lead(n), _SHORT_ENTRY, fold_to_counts(parts)), buckets, _counter(parts), "part int, raw binary", _SHORT_ENTRY, _part_row)
    first = those_with(led, F.floor(F.floor(F.col("n") * 3 / 4) / 8) + 1)

    def kept_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release("words")
        seen: set[int] = set()
        for batch in common.slices(batches, "body", 2 << 20):
            h, counts = sets_of(common.binary_list(batch.column("body")))
            keys = keys_of(h, counts)
            ends = np.cumsum(counts)
            rows = []
            for i in np.flatnonzero(_only(first.value, keys) & (counts > 0)).tolist():
                key = int(keys[i])
                if key not in seen:
                    seen.add(key)
                    rows.append((key, h[ends[i] - counts[i] : ends[i]].tobytes()))
            if len(seen) > 2_000_000:
                seen.clear()
            yield _batch(rows, ["key", "raw"], [pa.int64(), pa.binary()])

    sets = common.stored(lean.mapInArrow(kept_sets, "key long, raw binary"), "sets")
    # The second.
    covered = _gathered(_postings(sets, buckets, lambda n: n, _SHORT_ENTRY, fold_to_counts(parts)), buckets, _counter(parts), "part int, raw binary", _SHORT_ENTRY, _part_row)
    second = those_with(covered, F.ceil(F.col("n") * 3 / 4))

    def kept_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_only(second.value, batch.column("key").to_numpy())))

    # One row for each class: the copies that several tasks have seen fall out.
    left = common.stored(sets.mapInArrow(kept_again, "key long, raw binary").groupBy("key").agg(F.first("raw").alias("raw")), "left")
    common.removed(sets)
    # Candidate groups, and the blocks that they are dealt into.
    # Rare elements first: a passage that many documents share then links none that share nothing else.
    few = max(8, buckets // 8)
    total, elements = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("raw").cast("long")), F.lit(0)) / 8).first()
    often = spark.sparkContext.broadcast(_frequencies(left, cells_for(int(elements))))
    stars = _gathered(_postings(left, few, lambda n: n - need(n) + 1, _ENTRY, fold_to_stars, often), few, _stars, "a long, b long", _ENTRY, _pair_rows)
    groups = components(stars)
    # Sets that link are of one band of sizes or of neighbouring ones, so only blocks of these meet.
    placed = left.select("key", "raw", band_of((F.length("raw") / 8)).alias("band")).join(groups, F.col("key") == F.col("v")).drop("v")
    counted = common.stored(placed.groupBy("root", "band").agg(F.count("*").alias("size"), F.sum(F.length("raw").cast("long")).alias("bytes")), "sizes")
    bands = Window.partitionBy("root").orderBy("band")
    own = F.ceil(F.col("size") / BLOCK).cast("int")
    beside = lambda f, step: F.when(f("band").over(bands) == F.col("band") + step, f("blocks").over(bands)).otherwise(0)
    sizes = counted.withColumns({"blocks": own, "total": F.sum("size").over(Window.partitionBy("root"))}).withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)})
    small = F.col("total") <= BLOCK
    small_blocks = max(1, total // max(1, BLOCK // 2))
    block = lambda band, k: (band * (1 << 32) + k).cast("long")
    every = lambda step, n: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), lambda k: block(F.col("band") + step, k))
    dealt = placed.join(sizes, ["root", "band"]).select(
        "key",
        "raw",
        F.when(small, F.pmod(F.xxhash64("root"), F.lit(small_blocks))).otherwise(F.col("root")).alias("group"),
        F.when(small, F.lit(0).cast("long")).otherwise(block(F.col("band"), F.pmod(F.xxhash64(F.lit(5), F.col("key")), F.col("blocks")))).alias("own"),
        F.when(small, F.array(F.lit(0).cast("long"))).otherwise(F.concat(every(-1, "below"), every(0, "blocks"), every(1, "above"))).alias("others"),
    )

    def linked(rows: DataFrame, which=None) -> DataFrame:
        met = rows.select("key", "raw", "group", "own", F.explode("others").alias("other"))
        met = met.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "key", "raw")
        met = met if which is None else met.where(which)
        return met.repartition(buckets, "group", "i", "j").mapInArrow(_block_links, "a long, b long")

    times = F.when(small, 1).otherwise(F.col("below") + F.col("blocks") + F.col("above"))
    rounds = rounds_for(*sizes.agg(F.sum(F.col("bytes") * times), F.sum("bytes")).first())
    if rounds == 1:
        return linked(dealt), [left, counted]
    # What meets is more than fits the disk at once: a share of the pairs of blocks after the other, and only a forest is kept.
    dealt = common.stored(dealt, "dealt")
    common.removed(left)
    common.removed(counted)
    forest = None
    for k in range(rounds):
        edges = linked(dealt, F.pmod(F.xxhash64(F.lit(7), "group", "i", "j"), F.lit(rounds)) == k)
        edges = common.stored(edges if forest is None else edges.unionByName(forest), "links")
        joined = common.stored(components(edges).select(F.col("v").alias("a"), F.col("root").alias("b")), "joined")
        for done in (edges, forest):
            if done is not None:
                common.removed(done)
        forest = joined
    return forest, [dealt, forest]


def _rooted(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """doc_id, th (a hash of the text) and n_shingles of every row; and those with shingles, with the root of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release("words")
        for batch in common.slices(batches, "body", 2 << 20):
            h, counts = sets_of(common.binary_list(batch.column("body")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(counts.astype(np.int64)), pa.array(keys_of(h, counts))], names=["doc_id", "th", "n_shingles", "key"])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), common.text_bytes().alias("body"))
    named = common.stored(lean.mapInArrow(run, "doc_id long, th long, n_shingles long, key long"), "keys")
    classes = named.where("n_shingles > 0").groupBy("key").agg(F.first("n_shingles").alias("n"))
    found, done = links(docs, classes)
    forest = common.stored(components(found), "forest")
    for table in done:
        common.removed(table)
    rooted = named.where("n_shingles > 0").join(forest, named["key"] == forest["v"], "left").select("doc_id", "th", "n_shingles", F.coalesce("root", "key").alias("root"))
    return named.select("doc_id", "th", "n_shingles"), rooted


def ngram_components(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    named, rooted = _rooted(docs, id_col)
    # Written, so that the join below has an exchange on each side and can be split where a component is large.
    lowest = common.stored(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    linked = rooted.join(lowest, "root").select("doc_id", "n_shingles", "component_id")
    alone = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each group of rows that are linked, directly or not: that of the smallest doc_id (null
    last), then of the smallest hash of the text, then of the smallest other columns. Rows without words all stay."""
    named, rooted = _rooted(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    # Written, so that the join below has an exchange on each side and can be split where a group is large.
    first = common.stored(rooted.groupBy("root").agg(F.min(place).alias("first")), "first")
    own, th, row = (common.fresh(docs.columns, c) for c in ("gone", "th", "row"))
    gone = rooted.join(first, "root").where(place > F.col("first")).select(F.col("doc_id").alias(own), F.col("th").alias(th)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(th))
    left = docs.join(gone, same, "left_anti")
    # Rows that share both doc_id and text are one place.
    again = named.where("n_shingles > 0").groupBy(F.col("doc_id").alias(own), F.col("th").alias(th)).agg(F.count("*").alias(row)).where(F.col(row) > 1).drop(row)
    again = common.stored(again, "again")
    if again.isEmpty():
        return left
    one = left.join(again, same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias(th)).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return left.join(again, same, "left_anti").unionByName(one.select(f"{row}.*"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i : i + 4], ' ') AS k FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
