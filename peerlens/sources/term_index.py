"""A stored inverted index for BM25: built once, extended by new documents, asked without the corpus.

Every addition of documents is a segment of three tables below the index's folder, each dealt to buckets by term:

* `postings`: term, doc, block, f (occurrences), dl (the document's length);
* `blocks`: for each term and block of some documents the largest f and the least dl, which bound what the term can add to
  any score in the block, whatever the corpus grows to;
* `terms`: how many documents of the segment have the term.

`totals` has a row for each segment: documents and summed lengths. Documents must be new to the index.

A question reads the buckets of its terms only. Blocks are ranked by the sum of their terms' bounds; the leading ones are
scored, which gives a score that the k-th result has at least; of the others only blocks whose bound reaches it are scored.
The result is exact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bm25 import EPSILON, K1, B
from ..operators.dedup import first_of
from . import shared

BUCKETS, BLOCK_DOCS, LEADING = 64, 128, 4
#: Tokens of a task that makes postings, about.
TASK_TOKENS = 2_000_000


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def weight(f, dl, avgdl):
    """What a term adds to a score, but for its idf."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


class TermIndex:
    def __init__(self, spark: SparkSession, path: str, doc_type: str = "string", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS):
        self.spark, self.path, self.buckets, self.block_docs = spark, path.rstrip("/"), buckets, block_docs
        self.schemas = {
            "postings": f"term string, doc {doc_type}, block string, f long, dl long",
            "blocks": "term string, block string, most_f long, least_dl long",
            "terms": "term string, df long",
        }

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of all segments, or the buckets of it that are named."""
        segments = [s for s in shared.listed(self.spark, f"{self.path}/{name}") if s.startswith("segment=")]
        paths = []
        for s in segments:
            there = [b for b in shared.listed(self.spark, f"{self.path}/{name}/{s}") if b.startswith("bucket=")]
            paths += [f"{self.path}/{name}/{s}/{b}" for b in there if buckets is None or int(b.removeprefix("bucket=")) in buckets]
        schema = self.schemas[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, corpus: DataFrame, doc: str = "doc_id", tokens: str = "tokens") -> None:
        """corpus: new documents and their tokens. Counts of the segment are derived from its postings, not from the texts."""
        with shared.passing(self.spark):
            self._add(corpus, doc, tokens)

    def _add(self, corpus: DataFrame, doc: str, tokens: str) -> None:
        segment = uuid.uuid4().hex[:12]
        sized = corpus.select(F.col(doc).alias("doc"), F.size(tokens).cast("long").alias("dl"), F.col(tokens).alias("tokens"))
        n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        block = F.concat(F.lit(segment + ":"), F.pmod(F.xxhash64("doc"), F.lit(max(1, n // self.block_docs))).cast("string"))
        # Documents are dealt by block, a block to one task: its counts and files need no other exchange.
        parts = max(_partitions(self.spark), -(-total // TASK_TOKENS))
        dealt = sized.withColumn("block", block).repartition(parts, "block")
        postings = dealt.select("doc", "dl", "block", F.explode("tokens").alias("term")).groupBy("term", "doc", "block", "dl").agg(F.count(F.lit(1)).alias("f"))

        def write(name: str, df: DataFrame) -> None:
            """Each task writes the rows that it has of every bucket."""
            rows = df.select(*[c.split()[0] for c in self.schemas[name].split(", ")], self._bucket().alias("bucket"))
            rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/segment={segment}")

        write("postings", postings)
        own = self.spark.read.schema(self.schemas["postings"]).parquet(f"{self.path}/postings/segment={segment}")
        write("blocks", own.groupBy("term", "block").agg(F.max("f").alias("most_f"), F.min("dl").alias("least_dl")))
        write("terms", own.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        # The row of totals comes last: a segment without it was broken off.
        sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.path}/totals")
        self._means()

    def _means(self) -> None:
        """The mean idf of all terms, which stands in for negative ones: from the terms, once for each addition."""
        n, dl = self._sums()
        raw = self._read("terms").groupBy("term").agg(F.sum("df").alias("df")).select((F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        raw.agg(F.avg("raw").alias("mean")).select(F.lit(n).alias("n"), (F.lit(dl) / F.lit(max(1, n))).alias("avgdl"), "mean").write.mode("append").parquet(f"{self.path}/means")

    def _sums(self) -> tuple[int, int]:
        r = self.spark.read.schema("n long, dl long").parquet(f"{self.path}/totals").agg(F.sum("n"), F.sum("dl")).first()
        return r[0] or 0, r[1] or 0

    def search(self, queries: DataFrame, k: int, least: float, digits: int = 9) -> DataFrame:
        """query, doc, score: of each query (query, tokens) the k best documents with at least that score; ties, to so many
        digits, by doc."""
        asked = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))
        asked = shared.stored(asked, "asked")
        buckets = [r[0] for r in asked.select(self._bucket()).distinct().collect()]  # a number for each bucket
        stats = self.spark.read.schema("n long, avgdl double, mean double").parquet(f"{self.path}/means").orderBy(F.desc("n")).limit(1)
        idf = self._read("terms", buckets).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).join(F.broadcast(stats))
        raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = idf.select("term", "avgdl", F.when(raw < 0, EPSILON * F.col("mean")).otherwise(raw).alias("idf"))
        terms = shared.stored(asked.join(idf, "term").withColumn("factor", F.col("times") * F.col("idf")), "terms")

        def held(name: str) -> DataFrame:
            return self._read(name, buckets).join(terms, "term")

        most = F.greatest(F.lit(0.0), F.col("factor") * weight(F.col("most_f"), F.col("least_dl"), F.col("avgdl")))
        bounds = shared.stored(held("blocks").groupBy("query", "block").agg((F.sum(most) * (1 + 1e-9)).alias("bound")), "bounds")
        postings = self._read("postings", buckets).join(terms.select("term").distinct(), "term", "left_semi")
        parts = _partitions(self.spark)

        def scored(blocks: DataFrame, few: bool = False) -> DataFrame:
            # Postings are dealt by block as they are, and come to their queries there: what is sent doesn't grow with these.
            own = postings.join(blocks.select("block").distinct(), "block", "left_semi") if few else postings
            by_block = blocks.repartition(parts, "block").groupBy("block").agg(F.collect_set("query").alias("queries"))
            own = own.repartition(parts, "block").join(by_block, "block").join(terms, "term").where(F.array_contains("queries", F.col("query")))
            score = F.sum(F.col("factor") * weight(F.col("f"), F.col("dl"), F.col("avgdl")))
            out = own.groupBy("block", "query", "doc").agg(score.alias("score")).where(F.col("score") >= least).drop("block")
            return first_of(out.withColumn("place", F.round("score", digits)), ["query"], [F.col("place").desc(), F.col("doc")], k).drop("place")

        w = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        leading = shared.stored(bounds.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LEADING).drop("_n"), "leading-blocks")
        first = shared.stored(scored(leading, few=True), "leading")
        reached = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(least)).alias("reached"))
        wanted = bounds.join(leading.select("query", "block"), ["query", "block"], "left_anti").join(reached, "query", "left")
        rest = shared.stored(scored(wanted.where(F.col("bound") * (1 + 1e-9) + 10.0**-digits >= F.coalesce("reached", F.lit(least)))), "rest")
        both = first.unionByName(rest).withColumn("place", F.round("score", digits))
        return first_of(both, ["query"], [F.col("place").desc(), F.col("doc")], k).select("query", "doc", "score")
