"""Hard negatives by a two-dimensional block product of anchors and vectors.

Rows are dealt to shards of about `rows` vectors and their components to chunks of `dims`, so a block (shard, chunk) has a
bounded size. A block of anchors meets a block of vectors in the task of its tile and chunk, which gives a partial tile of
int64 scores; the shuffle brings the partial tiles of one tile together and they are added. Only the first few of each
anchor (or of each anchor's and positive's window) leave a tile, and a window over those gives the first few of all.

Two passes: same-label tiles give the positives, then all tiles give the negatives of the windows that the positives set.
Labels fall into `BUCKETS` buckets and shards hold one bucket each, so the first pass multiplies blocks of equal buckets
only. No anchor or vector list is held whole anywhere, and no cap lies on labels, anchors or windows.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; of rows
that repeat an id the one with the smallest label, then the smallest vector, takes part; a vector with fewer components
than another counts as having zeros behind them, an empty one scores 0 with everything; scaled components beyond 64 bits
saturate and scores beyond them wrap; ties go by id; an empty table, and one without anchors or positives, give no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ROWS, ANCHORS, DIMS, PIECE = 4096, 1024, 32, 128
POSITIVES, NEGATIVES = 5, 5
SCALE = 256.0
BUCKETS = 16
_BLOCK = "block int, bucket int, k int, ids binary, labels binary, info binary, body binary, item int"
_TILE = "i int, s int, j int, k int, a_ids binary, info binary, b_ids binary, b_labels binary, body binary, item int"


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes of 1, 2, 4 and 8 that hold them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(f"<i{n}" for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1))


def _ints(value, item: int = 8) -> np.ndarray:
    return np.frombuffer(value.as_py(), f"<i{item}").astype(np.int64)


def _dense(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row for each list, zeros behind its values."""
    lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), common.ragged(np.zeros(len(lists)), sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 product of a and b transposed: by doubles where these hold every sum exactly."""
    most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def scaled(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, label and the integer components v of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    lean = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    one = lean.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), v.alias("v")).alias("row"))
    return one.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def _dealt(bucket: Column, numbers: dict[int, tuple[int, int]]) -> Column:
    """The block of a row: one of its bucket's blocks (first, how many), by the hash of its id."""
    both = F.element_at(F.create_map(*[F.lit(x) for g, (at, n) in sorted(numbers.items()) for x in (g, f"{at} {n}")]), bucket)
    at, n = (F.split(both, " ")[k].cast("int") for k in (0, 1))
    return (at + F.pmod(F.xxhash64("vec_id"), n)).cast("int")


def _numbers(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    out, at = {}, 0
    for g, n in sorted(counts.items()):
        out[g] = (at, max(1, -(-n // size)))
        at += out[g][1]
    return out


def _blocks(rows: DataFrame, dims: int) -> DataFrame:
    """rows: block, bucket, vec_id, label, v, info. One row for each block and chunk of components; chunk 0 has every row."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("v") / dims).cast("int") - 1)), lambda k: F.slice("v", k * dims + 1, dims))
    cut = rows.select("block", "bucket", "vec_id", "label", "info", F.posexplode(chunks).alias("k", "part"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        body = _narrow(_dense(table["part"], dims))
        info = table["info"].combine_chunks()
        wide = _dense(table["info"], max([0, *np.diff(info.offsets.to_numpy()).tolist()]))
        raw = [table[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label")]
        values = [*(table[c][0].as_py() for c in ("block", "bucket", "k")), *raw, wide.astype("<i8").tobytes(), body.tobytes(), body.itemsize]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4 + [pa.int32()]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["block", "bucket", "k", "ids", "labels", "info", "body", "item"])

    return cut.groupBy("block", "k").applyInArrow(pack, _BLOCK)


def _tiles(anchors: DataFrame, vectors: DataFrame, i_of: Column, j_of: Column, dims: int, piece: int) -> DataFrame:
    """Partial tiles of the anchors' blocks with the vectors' blocks; i_of and j_of list the blocks that each has to meet."""
    left = anchors.select(F.col("block").alias("i"), F.explode(j_of).alias("j"), "k", "ids", "info", "body", "item")
    right = vectors.select(F.explode(i_of).alias("i"), F.col("block").alias("j"), "k", "ids", "labels", "body", "item")

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(10)]
        if a.num_rows and b.num_rows:
            a, b = a.to_pylist()[0], b.to_pylist()[0]
            x, y = (np.frombuffer(t["body"], f"<i{t['item']}").astype(np.int64).reshape(-1, dims) for t in (a, b))
            n = len(x)
            for s in range(0, n, piece):
                tile = _narrow(product(x[s : s + piece], y))
                cut = [t[len(t) // n * s : len(t) // n * min(n, s + piece)] for t in (a["ids"], a["info"])]
                # What the adding task needs once comes with chunk 0.
                row = [a["i"], s, a["j"], a["k"], cut[0], b"" if a["k"] else cut[1], b["ids"], b"" if a["k"] else b["labels"], tile.tobytes(), tile.itemsize]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = [pa.int32()] * 4 + [pa.binary()] * 5 + [pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _TILE.split(", ")])

    key = ["i", "j", "k"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(multiply, _TILE)


def _added(parts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors' ids and infos, the vectors' ids and labels, and the sum of the partial tiles."""
    order = np.argsort(parts["k"].to_numpy())
    first = int(order[0])
    a_ids, b_ids, labels = _ints(parts["a_ids"][first]), _ints(parts["b_ids"][first]), _ints(parts["b_labels"][first])
    info = _ints(parts["info"][first]).reshape(len(a_ids), -1)
    total = np.zeros((len(a_ids), len(b_ids)), np.int64)
    for k in order.tolist():
        own_a, own_b = _ints(parts["a_ids"][k]), _ints(parts["b_ids"][k])
        tile = _ints(parts["body"][k], parts["item"][k].as_py()).reshape(len(own_a), len(own_b))
        if tile.shape == total.shape:
            total += tile
        else:  # vectors of fewer components are missing in later chunks
            total[np.ix_(np.searchsorted(a_ids, own_a), np.searchsorted(b_ids, own_b))] += tile
    return a_ids, info, b_ids, labels, total


def _first(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, equal ones in their order."""
    if len(scores) > most:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        return near[np.argsort(~scores[near], kind="stable")[:most]]
    return np.argsort(~scores, kind="stable")


def _columns(parts: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(len(names))]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _positives(parts: pa.Table, most: int) -> pa.Table:
    a_ids, info, b_ids, labels, total = _added(parts)
    out = []
    for row, anchor in enumerate(a_ids.tolist()):
        own = np.flatnonzero((labels == info[row, 0]) & (b_ids != anchor))
        own = own[_first(total[row, own], most)]
        out.append([np.full(len(own), anchor), b_ids[own], total[row, own]])
    return _columns(out, ["anchor_id", "positive_id", "positive_score"])


def _negatives(parts: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """info: the anchor's label, then its positives' ids and scores in turn, then -1 of both where it has fewer."""
    a_ids, info, b_ids, labels, total = _added(parts)
    out = []
    for row, anchor in enumerate(a_ids.tolist()):
        n = int(info[row, 1])
        ids, scores = info[row, 2 : 2 + 2 * n : 2].tolist(), info[row, 3 : 3 + 2 * n : 2].tolist()
        other = np.flatnonzero(labels != info[row, 0])
        found = total[row, other]
        # low * p <= 100 * x <= high * p, in whole numbers
        spans = [(-(-low * p // 100), high * p // 100) for p in scores]
        near = (found >= min(b for b, _ in spans)) & (found <= max(e for _, e in spans))
        other, found = other[near], found[near]
        order = np.argsort(~found, kind="stable")
        other, found = other[order], found[order]
        for (b, e), positive, score in zip(spans, ids, scores, strict=True):
            start = int(np.searchsorted(~found, ~np.int64(e)))
            end = min(start + most, int(np.searchsorted(~found, ~np.int64(b), side="right")))
            if start < end:
                k = end - start
                out.append([np.full(k, anchor), np.full(k, positive), np.full(k, score), b_ids[other[start:end]], found[start:end]])
    return _columns(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _leading(df: DataFrame, keys: list[str], score: str, tie: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    every: int,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (80, 100),
    rows: int = ROWS,
    anchors: int = ANCHORS,
    dims: int = DIMS,
    piece: int = PIECE,
) -> DataFrame:
    """vectors: vec_id, label, v (as scaled() gives them, an id once). Anchors are the rows whose id `every` divides. For each
    anchor and each of its first `positives` rows of the same label: the first `negatives` rows of other labels whose
    scores lie within window, in hundredths of the positive's score."""
    spark = vectors.sparkSession
    every_row = common.stored(vectors.select("vec_id", "label", "v", F.pmod("label", F.lit(BUCKETS)).cast("int").alias("bucket")), "vectors")
    chosen = F.col("vec_id") % every == 0
    counted = every_row.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(chosen, 1)).alias("a")).collect()
    shards = _numbers({r["bucket"]: r["n"] for r in counted}, rows)
    fronts = _numbers({r["bucket"]: r["a"] for r in counted if r["a"]}, anchors)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not fronts:
        return spark.createDataFrame([], empty)
    blocks = common.stored(_blocks(every_row.select(_dealt(F.col("bucket"), shards).alias("block"), "bucket", "vec_id", "label", "v", F.array().cast("array<bigint>").alias("info")), dims), "blocks")
    front = every_row.where(chosen).withColumn("block", _dealt(F.col("bucket"), fronts))

    def listed(numbers: dict[int, tuple[int, int]]) -> Column:
        """The blocks of the row's own bucket."""
        both = {g: list(range(at, at + n)) for g, (at, n) in numbers.items()}
        text = F.element_at(F.create_map(*[F.lit(x) for g, v in sorted(both.items()) for x in (g, f"{v[0]} {v[-1]}")]), F.col("bucket"))
        ends = [F.split(text, " ")[k].cast("int") for k in (0, 1)]
        return F.when(text.isNotNull(), F.sequence(*ends)).otherwise(F.array().cast("array<int>"))

    def whole(numbers: dict[int, tuple[int, int]]) -> Column:
        at, n = numbers[max(numbers)]
        return F.sequence(F.lit(0), F.lit(at + n - 1))

    own = _blocks(front.select("block", "bucket", "vec_id", "label", "v", F.array("label").alias("info")), dims)
    tiles = _tiles(own, blocks, listed(fronts), listed(shards), dims, piece)
    near = tiles.groupBy("i", "s", "j").applyInArrow(lambda t: _positives(t, positives), "anchor_id long, positive_id long, positive_score long")
    near = common.stored(_leading(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")

    pairs = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.flatten(F.collect_list(F.array("positive_id", "positive_score"))).alias("pairs"))
    padded = F.concat("pairs", F.array_repeat(F.lit(-1).cast("bigint"), 2 * positives - F.size("pairs")))
    info = F.concat(F.array("label", (F.size("pairs") / 2).cast("bigint")), padded)
    own = _blocks(front.join(pairs, "vec_id").select("block", "bucket", "vec_id", "label", "v", info.alias("info")), dims)
    tiles = _tiles(own, blocks, whole(fronts), whole(shards), dims, piece)
    found = tiles.groupBy("i", "s", "j").applyInArrow(lambda t: _negatives(t, negatives, *window), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = _leading(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    out = common.stored(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    for done in (every_row, blocks, near):
        common.removed(done)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(scaled(shifted), every=100)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
