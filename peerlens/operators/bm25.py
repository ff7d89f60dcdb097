"""Okapi BM25 as joins and aggregates.

idf = ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes `EPSILON` times the mean idf of all terms. A query term that
occurs twice counts twice. Of the whole corpus only its terms and their counts are shuffled; its one-row totals are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .dedup import first_of

K1, B, EPSILON = 1.5, 0.75, 0.25
SECTION_LEAST = 1.3
TAG_LEAST, TAG_TOP = 2.0, 15
FACT_LEAST, FACT_TOP = 3.0, 1


def index(corpus: DataFrame, doc: str = "doc_id", tokens: str = "tokens", by: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """doc, term, weight: what each term adds to a document's score. With by, each of its values is a corpus of its own.
    With terms (term, each once) only theirs come out; all counts and means are still those of the whole corpus."""
    g = [F.col(by).alias("corpus")] if by else [F.lit("").alias("corpus")]
    sized = corpus.select(*g, F.col(doc).alias("doc"), F.size(tokens).alias("dl"), F.col(tokens).alias("tokens"))
    small = (lambda df: df) if by else F.broadcast  # one row without by
    # Distinct within the row, so that only terms and their counts are shuffled; a row without a term carries the document's
    # length, so that totals come from the same pass. What is left has a row for each term.
    once = F.concat(F.coalesce(F.array_distinct("tokens"), F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    held = sized.select("corpus", "dl", F.explode(once).alias("term"))
    counted = held.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"), F.avg(F.when(F.col("term").isNull(), F.col("dl"))).alias("avgdl"))
    counted = stored(counted, "terms")
    totals = counted.where("term is null").select("corpus", F.col("df").alias("n"), "avgdl")
    df = counted.where("term is not null").select("corpus", "term", "df").join(small(totals), "corpus")
    raw = df.select("corpus", "term", "avgdl", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.groupBy("corpus").agg(F.avg("raw").alias("mean"))
    # The terms come in after the mean, which is that of all.
    chosen = (lambda df: df.join(terms, "term")) if terms is not None else (lambda df: df)
    idf = chosen(raw).join(small(mean), "corpus").select("corpus", "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    tf = chosen(sized.select("corpus", "doc", "dl", F.explode("tokens").alias("term"))).groupBy("corpus", "doc", "dl", "term").agg(F.count("*").alias("f"))
    weight = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(idf, ["corpus", "term"]).select(*(["corpus"] if by else []), "doc", "term", weight.alias("weight"))


def scores(corpus: DataFrame, queries: DataFrame, doc: str = "doc_id", tokens: str = "tokens", by: str | None = None) -> DataFrame:
    """query, doc, score (with by: and corpus) of every document that has a term of the query. queries: query, tokens."""
    asked = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    keys = ["corpus"] if by else []
    weights = index(corpus, doc, tokens, by, asked.select("term").distinct())
    return weights.join(asked, "term").groupBy(*keys, "query", "doc").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))


def top(scored: DataFrame, n: int, least: float) -> DataFrame:
    return first_of(scored.where(F.col("score") >= least), ["query"], [F.col("score").desc(), F.col("doc")], n)


def found_or_fail(matched: DataFrame, what: str) -> DataFrame:
    """Fails if no section fits a search."""
    if matched.isEmpty():
        raise LookupError(f"no section found for {what}")
    return matched


def greedy(scored: DataFrame, queries: DataFrame, least: float = SECTION_LEAST) -> DataFrame:
    """Queries in order (ord) each take their best document that none before took; query, doc, score, by score. If scored has
    a column corpus, that is done in each corpus.

    The order is sequential by nature: it folds over the ranked candidates of all queries, of which there are at most as
    many for each query as there are queries.
    """
    by = ["corpus"] if "corpus" in scored.columns else []
    width = Window.partitionBy(*by, "query").orderBy(F.col("score").desc(), "doc")
    n = queries.count()
    short = scored.where(F.col("score") > least).withColumn("rank", F.row_number().over(width)).where(F.col("rank") <= n).join(queries.select("query", "ord"), "query")
    item = F.struct("ord", "rank", "query", "doc", "score")
    listed = short.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    taken = F.aggregate(
        "items",
        F.slice("items", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["doc"] == x["doc"]) | (y["query"] == x["query"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return listed.select(*by, F.inline(taken)).select(*by, "query", "doc", "score").orderBy(F.desc("score"), "query")
