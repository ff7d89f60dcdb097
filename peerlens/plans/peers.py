"""Peers: tags for the target's metrics, their facts, and their risks from filings."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import concepts, entities, text, tokens
from ..operators import batches, bm25, facts, graph
from .provider import Provider


def concept_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(concepts.rows(), "concept string, ordinal int, tag string")


def _known(metrics: DataFrame, term: str) -> DataFrame:
    """metric_type, ordinal, tag from the fixed table: the first form of the term that it has."""
    spark = metrics.sparkSession
    forms = metrics.select("metric_type", F.posexplode(tokens.concept_keys(F.col(term))).alias("form", "concept"))
    hit = forms.join(F.broadcast(concept_table(spark)), "concept")
    w = Window.partitionBy("metric_type")
    return hit.withColumn("_best", F.min("form").over(w)).where("form = _best").select("metric_type", "ordinal", "tag").distinct()


def candidate_tags(metrics: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """metrics (metric_type, gaap_concept) to metric_type, source_rank, ordinal, tag: from the fixed table by concept, else
    by type; else by lexical search in the taxonomy (tag, label), by concept, else by type."""
    base = metrics.select("metric_type", F.coalesce(text.blank_to_null(F.col("gaap_concept")), F.col("metric_type")).alias("concept_")).distinct()
    corpus = taxonomy.select("tag", tokens.label_or_tag_tokens(F.coalesce("label", F.lit("")), F.col("tag")).alias("tokens"))

    def searched(rest: DataFrame, term: str) -> DataFrame:
        asked = rest.select(F.col("metric_type").alias("query"), tokens.query_tokens(F.col(term)).alias("tokens"))
        best = bm25.top(bm25.scores(corpus, asked, doc="tag"), bm25.TAG_TOP, bm25.TAG_LEAST)
        w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
        return best.select(F.col("query").alias("metric_type"), (F.row_number().over(w) - 1).alias("ordinal"), F.col("doc").alias("tag"))

    out, rest = None, base
    for rank, find in enumerate((lambda r: _known(r, "concept_"), lambda r: _known(r, "metric_type"), lambda r: searched(r, "concept_"), lambda r: searched(r, "metric_type"))):
        found = find(rest).withColumn("source_rank", F.lit(rank))
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select("metric_type"), "metric_type", "left_anti")
    return out.select("metric_type", "source_rank", "ordinal", "tag")


def matched_facts(metrics: DataFrame, taxonomy: DataFrame, reported: DataFrame, fiscal_year: int) -> DataFrame:
    """Facts of the fiscal year for each company and metric: of the first candidate tag that has any, else of the tag whose
    label fits best among the company's own. Adds match_source and bm25_score."""
    annual = facts.in_fiscal_year(reported, fiscal_year)
    first = facts.first_hit(candidate_tags(metrics, taxonomy), annual).drop("source_rank", "ordinal")
    first = first.withColumns({"match_source": F.lit("global_taxonomy"), "bm25_score": F.lit(0.0)})
    corpus = reported.select("cik", "tag", "label").distinct().groupBy("cik", "tag").agg(F.first("label").alias("label"))
    corpus = corpus.select("cik", "tag", tokens.label_or_tag_tokens(F.coalesce("label", F.lit("")), F.col("tag")).alias("tokens"))
    term = F.coalesce(text.blank_to_null(F.col("gaap_concept")), F.col("metric_type"))
    asked = metrics.select(F.col("metric_type").alias("query"), tokens.query_tokens(term).alias("tokens")).dropDuplicates(["query"])
    scored = bm25.scores(corpus, asked, doc="tag", by="cik").where(F.col("score") >= bm25.FACT_LEAST)
    w = Window.partitionBy("corpus", "query").orderBy(F.desc("score"), "doc")
    best = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= bm25.FACT_TOP).select(F.col("corpus").alias("cik"), F.col("query").alias("metric_type"), F.col("doc").alias("tag"), F.round("score", 4).alias("bm25_score"))
    open_ = best.join(first.select("cik", "metric_type").distinct(), ["cik", "metric_type"], "left_anti")
    second = annual.join(open_, ["cik", "tag"]).withColumn("match_source", F.lit("bm25_fallback"))
    return first.unionByName(second)


def risk_texts(filings: DataFrame) -> DataFrame:
    """filings (cik, company, text) with section, individual_risks, risk_count, characters and words."""
    section = filings.withColumn("section", text.item_1a(F.col("text"))).drop("text")
    return section.withColumn("individual_risks", text.paragraphs(F.col("section"))).withColumns({"risk_count": F.size("individual_risks"), "characters": F.length("section"), "words": text.word_count(F.col("section"))})


def risk_batches(risks: DataFrame) -> DataFrame:
    """cik, company, batch, paragraphs, prompt: a filing's risks in batches of about 5000 characters."""
    return paragraph_batches(risks.select("cik", "company", F.posexplode("individual_risks").alias("pos", "t")))


def paragraph_batches(rows: DataFrame) -> DataFrame:
    """The same from a row for each paragraph (cik, company, pos, t). A filing may have any number of them."""
    dealt = batches.batched(rows.withColumn("_n", F.length("t")), ["cik", "company"], ["pos"], "_n", batches.by_size())
    grouped = dealt.groupBy("cik", "company", F.col("batch").cast("int").alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda p: p["t"]).alias("paragraphs"))
    return grouped.withColumn("prompt", text.numbered(F.col("paragraphs")))


def risk_prompts(filed: DataFrame, job: str) -> DataFrame:
    """What is asked for the batches of all filings."""
    return filed.select(F.lit(job).alias("job_id"), F.lit("peer_risks").alias("phase"), F.col("batch").alias("idx"), "prompt", "cik", "company", "paragraphs")


def structured_risks(filed: DataFrame, provider: Provider, job: str) -> DataFrame:
    """Validated risks of all batches with risk_id, citation_id and the paragraph they come from."""
    replies = provider.replies(risk_prompts(filed, job))
    rows = replies.select("cik", "company", F.col("idx").alias("batch"), "paragraphs", F.posexplode(text.json_array(F.col("reply"), text.struct_of(entities.RISK))).alias("pos", "r")).select("cik", "company", "batch", "pos", "paragraphs", "r.*")
    valid = entities.valid_peer_risks(rows, "").withColumn("organization", F.when(F.col("organization") == "", F.col("company")).otherwise(F.col("organization")))
    placed = valid.withColumn("source_text", entities.source_paragraph(F.col("paragraphs"), F.col("source_index"))).drop("paragraphs", "source_index")
    return graph.citation_ids(graph.risk_ids(placed.withColumn("job_id", F.lit(job)), ["batch", "pos"]), "PEER_R", ["cik", "batch", "pos"], ["job_id"]).drop("job_id")


def risk_totals(structured: DataFrame) -> DataFrame:
    """How many risks each company has, and all of them (cik null)."""
    return structured.rollup("cik").agg(F.count(F.lit(1)).alias("n_risks"))


def industry_codes(industries: DataFrame, codes: DataFrame) -> DataFrame:
    """industries with the code of codes (industry, code), whatever the case; null if there is none."""
    table = codes.select(F.lower(F.trim("industry")).alias("_key"), "code").dropDuplicates(["_key"])
    return industries.withColumn("_key", F.lower(F.trim("industry"))).join(table, "_key", "left").drop("_key")


def shared_prompts(chunks: DataFrame, key: str = "source_text") -> DataFrame:
    """Items that come from one text, together, so that the text is judged once."""
    return chunks.groupBy(key).agg(F.array_sort(F.collect_list("citation_id")).alias("citation_ids"), F.count("*").alias("n"))


def context_recall(components: DataFrame) -> DataFrame:
    """Mean of the components (component, score) that there are."""
    return components.agg(F.avg("score").alias("recall"))


def main(args: list[str] | None = None) -> None:
    """Loads a file of structured risks into the graph's tables of peers, risks and edges."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--risks-json", required=True)
    parser.add_argument("--target-company", required=True)
    parser.add_argument("--graph", required=True, help="the folder of the graph's tables")
    parser.add_argument("--clear", action="store_true")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    schema = "company_name string, cik string, structured_risks array<struct<risk_id:string,citation_id:string,risk_name:string,description:string,why:string>>"
    rows = spark.read.schema(schema).json(given.risks_json, multiLine=True).select("company_name", "cik", F.inline("structured_risks")).where("risk_id is not null")
    peers = rows.select(F.col("company_name").alias("name"), "cik").distinct()
    edges = graph.competes_with(peers, spark.createDataFrame([(given.target_company,)], "name string"))
    mode = "overwrite" if given.clear else "append"
    for name, table in (("peers", peers), ("risks", rows), ("edges", edges)):
        table.write.mode(mode).parquet(f"{given.graph}/{name}")


if __name__ == "__main__":
    main()
