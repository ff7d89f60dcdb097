"""Ranked lexical search over document-sharded postings with integer impacts.

The index is a table of shards. A shard holds up to `docs` documents or `postings` postings, in ascending order of doc_id,
as compressed sparse rows: for each term the documents of the shard that have it, and how often. Frequencies of terms over
all shards are summed by Spark, so every shard can turn its counts into integer impacts, the same ones whatever the
sharding. A query is answered term at a time: the impacts of a term's postings are added to one accumulator per document of
the shard; the highest totals leave the shard (all that tie with the last of them are looked at, the smaller doc_ids stay),
and a window over the shards' leaders gives the first of all.

The terms that are indexed are those of a block of queries: `block_bytes` of query text, which bounds what a task is sent.
More queries pass in further blocks; each reads every document. The documents' side is never sent, collected or shuffled:
only (term, frequency) pairs and leaders are.

Defined cases: null and empty texts have no term, count in nothing and are never found; rows that repeat a doc_id are
documents of their own, and a null doc_id ranks behind others of equal score; rows of queries that share an item_id (null
too) are one item with the terms of all; an item without known terms gives no rows, as do an empty table of documents or of
items; a very long text is one document like another. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP = 50
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 21
BLOCK_BYTES = 1 << 20
#: Every byte that ends a term becomes a space, A-Z become a-z.
_TABLE = bytes(b if b > 0x7F or chr(b).isalnum() and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SHARD = "docs binary, nulls binary, sizes binary, n_docs long, n_terms long, terms binary, starts binary, places binary, counts binary"


def terms_of(body: bytes) -> list[bytes]:
    return body.translate(_TABLE).split()


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def index(docs: DataFrame, known: dict[bytes, int], shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The shards: postings of the known terms (by their numbers), and every document's length in terms."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    names = [c.split()[0] for c in _SHARD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        number = sent.value.get
        names_: list[pa.Array] = []
        sizes: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            ids = pa.concat_arrays(names_)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy()
            order = np.lexsort((doc, null))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            length = np.array(sizes, np.int64)
            place, term, count = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            place = rank[place]
            by = np.lexsort((place, term))
            own, starts = np.unique(term[by], return_index=True)
            starts = np.append(starts, len(by))
            parts = [doc[order].astype("<i8"), null[order].astype(np.uint8), length[order].astype("<i8"), len(order), int(length.sum()), own.astype("<i4"), starts.astype("<i4"), place[by].astype("<i4"), count[by].astype("<i4")]
            names_.clear(), sizes.clear(), found.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()) if isinstance(p, int) else pa.array([p.tobytes()], pa.binary()) for p in parts], names=names)

        for batch in common.slices(batches, "text", 1 << 20):
            lists = [terms_of(body) for body in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(map(number, chain.from_iterable(lists), repeat(-1)), np.int64, int(counts.sum()))
            lists.clear()
            some = counts > 0  # documents without terms are in no statistic
            local = np.repeat(np.cumsum(some) - 1, counts)
            hit = flat >= 0
            pairs, tf = np.unique((local[hit] << 32) | flat[hit], return_counts=True)
            found.append(((pairs >> 32) + len(sizes), pairs & 0xFFFFFFFF, tf))
            names_.append(batch.column("doc_id").filter(pa.array(some)))
            sizes += counts[some].tolist()
            held += len(pairs)
            if len(sizes) >= shard_docs or held >= shard_postings:
                yield flush()
        if sizes:
            yield flush()

    return lean.mapInArrow(run, _SHARD)


def _leaders(total: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest totals above 0, equal ones in their order."""
    own = np.flatnonzero(total > 0)
    score = total[own]
    if len(own) > most:
        cut = np.partition(score, len(score) - most)[len(score) - most]
        above = own[score > cut]
        own = np.sort(np.concatenate([above, own[score == cut][: most - len(above)]]))
    return own[np.argsort(-total[own], kind="stable")]


def _search(docs: DataFrame, items: dict[str | None, list[bytes]], top: int, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Leaders of every shard for one block of items (item as text, doc_id, score), and the shards."""
    spark = docs.sparkSession
    known = {t: k for k, t in enumerate(sorted({t for own in items.values() for t in own}))}
    shards = common.stored(index(docs, known, **sizes), "shards")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), "<i4"), pa.int32()), pa.array(np.diff(np.frombuffer(starts.as_py(), "<i4")), pa.int64())], names=["term", "df"])

    # A number for each term of the block, and two for the corpus.
    df = {r["term"]: r["df"] for r in shards.select("terms", "starts").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    all_docs, all_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = np.array([weight(all_docs, df.get(k, 0)) for k in range(len(known))], np.int64)
    asked = [(name, np.array(sorted(known[t] for t in own), np.int64)) for name, own in items.items()]
    sent = spark.sparkContext.broadcast((weights, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        weights, asked = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                raw = {c: batch.column(c)[row].as_py() for c in ("docs", "nulls", "sizes", "terms", "starts", "places", "counts")}
                doc, size = (np.frombuffer(raw[c], "<i8") for c in ("docs", "sizes"))
                null = np.frombuffer(raw["nulls"], np.uint8) > 0
                terms, starts, places, tf = (np.frombuffer(raw[c], "<i4") for c in ("terms", "starts", "places", "counts"))
                longer = 50 + 50 * size * all_docs // all_terms
                tf = tf.astype(np.int64)
                impact = np.repeat(weights[terms], np.diff(starts)) * (1_000_000_000 * tf // (1000 * tf + 20 * longer[places]))
                total = np.zeros(len(doc), np.int64)
                names, ids, scores = [], [], []
                for name, numbers in asked:
                    total[:] = 0
                    at = np.searchsorted(terms, numbers)
                    for k in at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == numbers)].tolist() if len(terms) else ():
                        b, e = starts[k], starts[k + 1]
                        total[places[b:e]] += impact[b:e]  # a term has a document once
                    best = _leaders(total, top)
                    names += [name] * len(best)
                    ids.append(pa.array(doc[best], mask=null[best]))
                    scores.append(total[best])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.concat_arrays([pa.array([], pa.int64()), *ids]), pa.array(np.concatenate([np.zeros(0, np.int64), *scores]))], names=["item", "doc_id", "score"])

    return shards.select("docs", "nulls", "sizes", "terms", "starts", "places", "counts").mapInArrow(run, "item string, doc_id long, score long"), shards


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, **sizes: int) -> DataFrame:
    """items: item_id and text. The first `top` documents of each item: item_id, rank, doc_id, score."""
    kind = items.schema["item_id"].dataType
    lean = items.select(F.col("item_id").cast("string").alias("item"), common.text_bytes().alias("body"))
    total = lean.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    dealt = lean.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = None
    for k in range(blocks):
        # About block_bytes reach the driver at a time.
        own: dict[str | None, set[bytes]] = {}
        for r in dealt.where(F.col("block") == k).collect():
            own.setdefault(r["item"], set()).update(terms_of(bytes(r["body"])))
        found, shards = _search(docs, {name: sorted(t) for name, t in own.items()}, top, **sizes)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = found.withColumn("rank", rank).where(F.col("rank") <= top)
        found = found.select(F.col("item").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = common.stored(found, "found")
        common.removed(shards)
        out = found if out is None else out.unionByName(found)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM d, a),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY 1),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
