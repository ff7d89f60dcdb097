"""Removes repeated byte strings of `LENGTH` bytes or more, by suffix arrays over the places that may repeat.

1. Every window of `LENGTH` bytes selects its k-gram of least hash. Equal windows select equal k-grams at equal offsets, so
   a window can only repeat where its selected k-gram (an anchor) occurs again. An anchor with what surrounds it (all
   windows that contain it) is a context. Anchors that occur once fall out, which leaves the texts' unique parts.
2. Contexts that occur twice as a whole are repeated as a whole, however many copies there are; a group of near copies
   shrinks to its distinct contexts.
3. The distinct contexts of an anchor go to a shard, without the anchor itself: it stands at the same place in all windows
   that are compared, so they are equal if what is left and right of it is. Each shard builds a suffix array
   (Larsson-Sadakane refinement: only groups of suffixes that are still equal are sorted again, by the ranks of the
   suffixes h further on) and the common prefixes of neighbours (Kasai, one lane for each context). Suffixes that share
   what a window has beside its anchor mark their windows.
4. An anchor with more than `SHARD` distinct contexts is dealt to several shards. Each gives the sorted digests of its
   windows, cut into ranges; the ranges of all shards meet and are merged by binary search.

A text that occurs more than once repeats wholly. Strings are compared in the input; what is removed elsewhere plays no
role, and all occurrences are removed.

Defined cases: a null text counts as empty; a text of fewer than `LENGTH` bytes loses nothing; rows with equal texts,
repeated doc_ids included, are copies of one another; an empty table gives no rows. A very long text is one row, whose
hashes (8 bytes for each of its own) are made together. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_join import _ENTRY, CELLS, _batch, _bitmap, _bucketed, _gathered, _parts, _reduced, _shared

LENGTH = 400
GRAM = 256
SHARD = 1024
#: Bytes of contexts in one suffix array.
CHUNK = 1 << 18
#: Bytes of texts whose hashes are made together: arrays of this many longs stay in a core's cache.
BLOCK = 1 << 15
#: Bits of the maps that tell which anchors are looked for.
BITS = 1 << 24
_U = np.uint64
_TABLE = common.mix64(np.arange(301, 557, dtype=np.uint64))
_STEPS = common.mix64(np.arange(11, 23, dtype=np.uint64)) | _U(1)
_PLACE = _U((1 << 28) - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Of the k-gram at every place; gram is a power of two."""
    h, size, k = _TABLE[data], 1, 0
    while size < gram:
        h = h[:-size] * _STEPS[k] + h[size:]
        size, k = 2 * size, k + 1
    return common.mix64(h)


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(bodies: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text (its place in bodies), pos, hash, left (bytes before it in its context) and size (of the context)."""
    parts, begin, held = [], 0, 0
    for i, body in enumerate(bodies, 1):
        held += len(body) if len(body) >= length else 0
        if held >= BLOCK or i == len(bodies):
            text, *rest = _anchors(bodies[begin:i], length, gram)
            parts.append((text + begin, *rest))
            begin, held = i, 0
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else _anchors([], length, gram)


def _anchors(bodies: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    width = length - gram + 1
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    data = np.frombuffer(b"".join(bodies[i] for i in long.tolist()), np.uint8)
    n = sizes[long]
    ends = np.cumsum(n)
    h = gram_hashes(data, gram)
    least = _window_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width)
    # Only windows inside one text.
    starts = common.ragged(ends - n, n - length + 1)
    at = least[starts] & _PLACE
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at = at[new].astype(np.int64)
    text = np.searchsorted(ends, at, side="right")
    pos = at - (ends - n)[text]
    left = np.minimum(pos, width - 1)
    size = left + np.minimum(n[text] - pos, length)
    return long[text], pos, h[at], left, size


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array of data, by Larsson-Sadakane refinement in numpy."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    key = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        part = padded[k : k + 8 * ((n - k + 7) // 8)].view(">u8")
        key[k::8] = part[: len(key[k::8])]
    active = np.argsort(key)
    pair = key[active]
    rank = np.zeros(n, np.int64)
    depth = 8
    while len(active):
        place = np.arange(len(active))
        new, first = np.ones(len(active), bool), np.zeros(len(active), bool)
        new[1:] = pair[1:] != pair[:-1]
        old = rank[active]
        first[0] = True
        first[1:] = old[1:] != old[:-1]
        # A group keeps its place and is divided; its parts are numbered by where they begin.
        rank[active] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        # Suffixes alone in their group are in place and aren't sorted again.
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        further = active + depth
        # Where data ends within the part compared so far, the shorter suffix comes first.
        second = np.where(further < n, rank[np.minimum(further, n - 1)], n - 1 - further)
        pair = rank[active] * (n + depth + 1) + second + depth
        order = np.argsort(pair)
        active, pair = active[order], pair[order]
        depth *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def kasai(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, end_of: np.ndarray, most: int, least: int = 1) -> np.ndarray:
    """Common prefix (up to `most`) of every suffix of `least` bytes or more with the one of them before it in the order
    (before: -1 if none).

    Each context is a lane that walks through its suffixes from left to right and keeps what is left of the last prefix,
    unless the suffix it was shared with is the last one of its context.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.zeros(n, np.uint64)
    for k in range(8):
        wide |= padded[k : k + n].astype(np.uint64) << _U(8 * k)
    out = np.zeros(n, np.int64)
    lane = np.flatnonzero(ends - starts >= least)
    i, known = starts[lane], np.zeros(len(lane), np.int64)
    while len(i):
        j = before[i]
        other = np.maximum(j, 0)
        room = np.where(j < 0, 0, np.minimum(np.minimum(ends[lane] - i, end_of[other] - other), most))
        left = room - known
        a, b = np.minimum(i + known, n - 1), np.minimum(other + known, n - 1)
        eight = (left >= 8) & (wide[a] == wide[b])
        one = ~eight & (left > 0) & (data[a] == data[b])
        known += np.where(eight, 8, one)
        done = ~eight & ~one
        out[i[done]] = np.minimum(known[done], room[done])
        known = np.where(done, np.where(other + least < end_of[other], np.maximum(known - 1, 0), 0), known)
        i = i + done
        stay = i + least <= ends[lane]
        if not stay.all():
            i, lane, known = i[stay], lane[stay], known[stay]
    return out


def repeated_windows(contexts: list[bytes], lefts: list[int], groups: list, length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each context the starts of its windows, whether each occurs in another context of its group at the same
    distance from the anchor, and the number of its class of equal windows."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    data = np.frombuffer(b"\0".join(contexts), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    end_of = np.repeat(ends, sizes + 1)[: len(data)]
    order = suffix_order(data)
    # A suffix that its context cuts shorter than `length` has no part in any run.
    order = order[order + length <= end_of[order]]
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    lcp = kasai(data, starts, ends, before, end_of, length, length)
    # Suffixes of one run share `length` bytes.
    run = np.zeros(len(data), np.int64)
    run[order] = np.cumsum(lcp[order] < length)
    counts = np.maximum(sizes - length + 1, 0)
    at = common.ragged(starts, counts)
    own = np.repeat(np.arange(len(contexts)), counts)
    number = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    group = np.array([number[g] for g in groups], np.int64)[own]
    distance = at - starts[own] - np.asarray(lefts, np.int64)[own] + length
    key = (run[at] * len(number) + group) * (2 * length + 1) + distance
    order = np.argsort(key)
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    label = np.cumsum(first) - 1
    again = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, bool)
    hit, kind = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    hit[order], kind[order] = again, label
    return np.split(at - starts[own], np.cumsum(counts)[:-1]), hit, kind


_CONTEXT = "f long, c1 long, c2 long"
_WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("c1", "<i8"), ("c2", "<i8"), ("d", "<i4")])


@common.tidy
def _shard(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows f, c1, c2, left, body (without the anchor, which all contexts of f share), shards, shard; several tasks may
    have sent the same context. Gives ranges (kind 0: b and e, from the anchor) and, of anchors in
    several shards, packed windows (kind 1: part and raw)."""
    held: dict[tuple[int, int], dict[tuple[int, int], tuple]] = {}
    inner = length - gram
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("f", "c1", "c2", "left", "body", "shards", "shard")]
        for f, c1, c2, left, body, shards, shard in zip(*cols, strict=True):
            held.setdefault((f, shard), {}).setdefault((c1, c2), (c1, c2, left, body, shards))

    def solve(keys: list[tuple[int, int]]) -> pa.RecordBatch:
        items = [(key, *item) for key in keys for item in held.pop(key).values()]
        lefts = np.array([x[3] for x in items])
        starts, hit, kind = repeated_windows([x[4] for x in items], lefts, [x[0] for x in items], inner)
        counts = np.fromiter(map(len, starts), np.int64, len(items))
        start, own = np.concatenate(starts), np.repeat(np.arange(len(items)), counts)
        # All windows of a context hold its anchor, so what they cover is one range.
        marked = np.flatnonzero(hit)
        of, first = np.unique(own[marked], return_index=True)
        last = np.append(first[1:], len(marked))[: len(first)] - 1
        rows = [(items[i][0][0], items[i][1], items[i][2], 0, b, e, b"") for i, b, e in zip(of.tolist(), (start[marked[first]] - lefts[of]).tolist(), (start[marked[last]] - lefts[of] + length).tolist(), strict=True)]
        shards = np.array([x[5] for x in items])
        if (shards > 1).any():
            # One window of each class goes on: where the class has more, all are marked already.
            go = np.zeros(len(own), bool)
            go[np.unique(kind, return_index=True)[1]] = True
            at = np.flatnonzero(go & (shards[own] > 1))
            raw = np.zeros(len(at), _WINDOW)
            digests = b"".join(xxhash.xxh3_128_digest(items[i][4][s : s + inner]) for i, s in zip(own[at].tolist(), start[at].tolist(), strict=True))
            raw["w1"], raw["w2"] = np.frombuffer(digests, ">u8").reshape(-1, 2).T
            for name, k in (("c1", 1), ("c2", 2)):
                raw[name] = np.array([x[k] for x in items])[own[at]]
            raw["d"] = start[at] - lefts[own[at]]
            names = np.array([x[0][0] for x in items])[own[at]]
            part = ((raw["w1"] >> _U(40)) % (shards[own[at]] // 4 + 1).astype(np.uint64)).astype(np.int64)
            order = np.lexsort((raw["w2"], raw["w1"], part, names))
            raw, names, part = raw[order], names[order], part[order]
            new = np.ones(len(at), bool)
            new[1:] = (names[1:] != names[:-1]) | (part[1:] != part[:-1])
            cut = np.flatnonzero(new)
            rows += [(int(names[b]), 0, 0, 1, int(part[b]), 0, raw[b:e].tobytes()) for b, e in zip(cut.tolist(), np.append(cut[1:], len(at)).tolist(), strict=False)]
        return _batch(rows, ["f", "c1", "c2", "kind", "b", "e", "raw"], [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()])

    keys, size = [], 0
    for key in list(held):
        items_ = list(held[key].values())
        if len(items_) > 1 or items_[0][4] > 1:
            keys.append(key)
            size += sum(len(x[3]) for x in items_)
            if size >= CHUNK:
                yield solve(keys)
                keys, size = [], 0
    if keys:
        yield solve(keys)


@common.tidy
def _merge(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows f, b (part) and raw of several shards, each sorted. Gives the ranges of windows that two shards have."""
    held: dict[tuple[int, int], list[bytes]] = {}
    for batch in batches:
        for f, part, raw in zip(*(batch.column(c).to_pylist() for c in ("f", "b", "raw")), strict=True):
            held.setdefault((f, part), []).append(raw)
    for (f, _), raws in held.items():
        shards = [np.frombuffer(r, _WINDOW) for r in raws]
        keys = [s["w1"] ^ common.mix64(s["w2"] + s["d"].astype(np.int64).view(np.uint64) * _STEPS[0]) for s in shards]
        union = np.unique(np.concatenate(keys))
        # Each shard's windows are found in the union by binary search; a window is in a shard's list once.
        places = [np.searchsorted(union, k) for k in keys]
        times = np.bincount(np.concatenate(places), minlength=len(union))
        found = np.concatenate([s[times[at] > 1] for s, at in zip(shards, places, strict=True)])
        found = found[np.lexsort((found["d"], found["c2"], found["c1"]))]
        new = np.ones(len(found), bool)
        new[1:] = (found["c1"][1:] != found["c1"][:-1]) | (found["c2"][1:] != found["c2"][:-1])
        first = np.flatnonzero(new)
        n = len(first)
        last = np.append(first[1:], len(found))[:n] - 1
        cols = [pa.array(np.full(n, f)), pa.array(found["c1"][first]), pa.array(found["c2"][first]), pa.array(np.zeros(n, np.int32)), pa.array(found["d"][first]), pa.array((found["d"][last] + length).astype(np.int32)), pa.array([b""] * n, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["f", "c1", "c2", "kind", "b", "e", "raw"])


def _two_of_each(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of every hash: enough to tell that it occurs twice, however often it does."""
    order = np.lexsort((place, h))
    h, place = h[order], place[order]
    edge = np.ones(len(h) + 1, bool)
    edge[1:-1] = h[1:] != h[:-1]
    some = edge[:-1] | edge[1:]
    return h[some], place[some]


def _key(col: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(col))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> tuple[DataFrame, list[DataFrame]]:
    """t1, t2 (the text's name: two hashes) and spans (array of b, e) of every distinct text in which strings repeat; and the
    tables that can be removed when these have been read."""
    spark = docs.sparkSession
    lean = docs.select(common.text_bytes().alias("body")).select("body", _key("body", 1).alias("t1"), _key("body", 2).alias("t2"))

    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    @common.tidy
    def found(batches: Iterator[pa.RecordBatch], known, bodies_too: bool = False) -> Iterator[pa.RecordBatch]:
        """Without known, all anchors, packed. Else a row for each anchor whose bit is set, or each context with its bytes."""
        known = None if known is None else known.value
        seen: set = set()
        given: set = set()
        for batch in common.slices(batches, "body", 2 << 20):
            bodies = common.binary_list(batch.column("body"))
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            first = []
            for t in zip(t1.tolist(), t2.tolist(), strict=True):
                first.append(t not in seen)
                seen.add(t)
            if len(seen) > 300_000:
                seen.clear()
            text, pos, h, left, size = anchors([b if ok else b"" for b, ok in zip(bodies, first, strict=True)], length, gram)
            if known is None:
                place = common.mix64(t1[text].view(np.uint64) ^ (t2[text].view(np.uint64) * _STEPS[1]) ^ (pos.astype(np.uint64) * _STEPS[2])).view(np.int64)
                yield _batch(list(_bucketed(*_two_of_each(h, place), parts, _ENTRY)), ["bucket", "raw"], [pa.int32(), pa.binary()])
                continue
            place = h % _U(BITS)
            some = (known[(place >> _U(3)).astype(np.int64)] >> (_U(7) - (place & _U(7))).astype(np.uint8)) & 1 > 0
            text, pos, h, left, size = (x[some] for x in (text, pos, h, left, size))
            pieces = [bodies[t][p - b : p - b + s] for t, p, b, s in zip(text.tolist(), pos.tolist(), left.tolist(), size.tolist(), strict=True)]
            names = [xxhash.xxh3_128_intdigest(piece, seed=b) for piece, b in zip(pieces, left.tolist(), strict=True)]
            if bodies_too:
                new = []
                for i, name in enumerate(names):
                    if name not in given:
                        given.add(name)
                        new.append(i)
                if len(given) > 200_000:
                    given.clear()
                names, h, left = [names[i] for i in new], h[new], left[new]
                pieces = [pieces[i][:b] + pieces[i][b + gram :] for i, b in zip(new, left.tolist(), strict=True)]
            c1 = np.fromiter((x >> 64 for x in names), np.uint64, len(names)).view(np.int64)
            c2 = np.fromiter((x & 0xFFFFFFFFFFFFFFFF for x in names), np.uint64, len(names)).view(np.int64)
            cols = [pa.array(h.view(np.int64)), pa.array(c1), pa.array(c2), pa.array(left.astype(np.int32))]
            if bodies_too:
                shards = np.maximum(1, -(-loads.value[(h % _U(CELLS)).astype(np.int64)].astype(np.int64) // shard)).astype(np.int32)
                own = (c1.view(np.uint64) % shards.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pieces, pa.binary()), pa.array(shards), pa.array(own)], names=["f", "c1", "c2", "left", "body", "shards", "shard"])
            else:
                cols += [pa.array(t1[text]), pa.array(t2[text]), pa.array(pos), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["f", "c1", "c2", "left", "t1", "t2", "pos", "size"])

    def anchors_again(token: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(token[_shared(token)]).view(np.int64))], names=["key"])

    def sent(keys: DataFrame):
        return spark.sparkContext.broadcast(_bitmap(keys, BITS))

    twice = sent(_gathered(lean.mapInArrow(lambda b: found(b, None), "bucket int, raw binary"), parts, anchors_again, "key long", _ENTRY))
    rows = lean.mapInArrow(lambda b: found(b, twice), _CONTEXT + ", left int, t1 long, t2 long, pos long, size int")
    again = common.stored(rows, "again")
    place = F.struct("t1", "t2", "pos")
    kinds = again.groupBy("f", "c1", "c2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.first("left").alias("left"), F.first("size").alias("size"))
    kinds = common.stored(kinds.select("f", "c1", "c2", (F.col("lo") < F.col("hi")).alias("whole"), "left", "size"), "kinds")
    several = kinds.groupBy("f").agg(F.count("*").alias("n")).where("n > 1")
    bits = sent(several.select(F.col("f").alias("key")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            cells += np.bincount((batch.column("f").to_numpy().view(np.uint64) % _U(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        yield _parts(cells)

    # How many contexts an anchor has at most, in a table of fixed size: this alone decides into how many shards it goes.
    loads = spark.sparkContext.broadcast(_reduced(kinds.select("f").mapInArrow(counted, "part int, raw binary"), CELLS, np.uint32, np.add))
    contexts = lean.mapInArrow(lambda b: found(b, bits, True), _CONTEXT + ", left int, body binary, shards int, shard int")
    schema = _CONTEXT + ", kind int, b int, e int, raw binary"
    solved = common.stored(contexts.repartition(parts, "f", "shard").mapInArrow(lambda b: _shard(b, length, gram), schema), "solved")
    across = solved.where("kind = 1").select("f", "b", "raw").repartition(parts, "f", "b").mapInArrow(lambda b: _merge(b, length), schema)
    ranges = solved.where("kind = 0").unionByName(across).select("f", "c1", "c2", "b", "e")
    ranges = ranges.unionByName(kinds.where("whole").select("f", "c1", "c2", (-F.col("left")).alias("b"), (F.col("size") - F.col("left")).alias("e")))
    # Written, so that the join has an exchange on each side and can be split where one context has very many places.
    covered = common.stored(ranges.groupBy("f", "c1", "c2").agg(F.collect_set(F.struct("b", "e")).alias("ranges")), "covered")
    spans = again.join(covered, ["f", "c1", "c2"]).select("t1", "t2", F.transform("ranges", lambda r: F.struct((F.col("pos") + r["b"]).alias("b"), (F.col("pos") + r["e"]).alias("e"))).alias("spans"))
    return spans.groupBy("t1", "t2").agg(F.flatten(F.collect_set("spans")).alias("spans")), [again, kinds, solved, covered]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_kept: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_kept: and kept, the bytes that stay) of every row."""
    named = docs.select("doc_id", common.text_bytes().alias("body")).select("doc_id", "body", _key("body", 1).alias("t1"), _key("body", 2).alias("t2"))
    copies = named.groupBy("t1", "t2").count().where("count > 1").select("t1", "t2", F.lit(True).alias("copied"))
    spans, done = repeats(docs, length, **options)
    facts = common.stored(spans.join(copies, ["t1", "t2"], "full"), "spans")
    for table in done:
        common.removed(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "body", 2 << 20):
            rows = []
            for doc_id, body, found, copied in zip(batch.column("doc_id").to_pylist(), common.binary_list(batch.column("body")), batch.column("spans").to_pylist(), batch.column("copied").to_pylist(), strict=True):
                gone = [(0, len(body))] if copied and len(body) >= length else _merged([(s["b"], s["e"]) for s in found or ()])
                parts, at = [], 0
                for b, e in gone:
                    parts.append(body[at:b])
                    at = e
                kept = b"".join([*parts, body[at:]])
                rows.append((doc_id, len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
            yield _batch(rows, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept], [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return named.join(facts, ["t1", "t2"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "body", "spans", "copied").mapInArrow(run, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.table(spark, sf_dir, "documents"))
