"""Scorecards and the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text

#: Weights of the overall score and of its gates.
WEIGHTS = (("evidence_quality", 0.30), ("faithfulness", 0.25), ("context_precision", 0.25), ("answer_relevancy", 0.20))
EVIDENCE = ("risks_validation", "metrics_validation", "target_validation")
OVERALL_GATE, PART_GATE = (0.80, 0.65), (0.70, 0.50)
SUMMARY_MARKS = ("** TOP-3 MEAN **", "** MEAN **", "** SUMMARY **", "** OVERALL **")


def claim_score(correct: Column, source: Column) -> Column:
    """1 for the right source, 0 for an invented one, a half for another real one."""
    return F.when(correct, 1.0).when(F.upper(text.strip(F.coalesce(source, F.lit("")))) == "FABRICATED", 0.0).otherwise(0.5)


def faithfulness(claims: DataFrame, by: list[str] | None = None) -> DataFrame:
    rows = claims.where(F.length(F.trim("claim_id")) > 0)
    correct, source = F.coalesce("is_correct_source", F.lit(False)), text.strip(F.coalesce("correct_source", F.lit("")))
    return rows.groupBy(*(by or [])).agg(
        F.avg(claim_score(correct, source)).alias("score"),
        F.count_if(correct).alias("n_correct"),
        F.count_if(~correct & (F.upper(source) == "FABRICATED")).alias("n_fabricated"),
        F.count_if(~correct & (F.upper(source) == "ERROR")).alias("n_error"),
        F.count("*").alias("n_claims"),
    )


def share_true(rows: DataFrame, flag: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Share of rows with a key whose flag is true."""
    kept = rows.where(F.length(F.trim(F.col(key).cast("string"))) > 0)
    return kept.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_true"), F.avg(F.col(flag).cast("double")).alias("score"))


def relevancy(original: Column, generated: Column) -> tuple[Column, Column]:
    """Similarities of the generated questions' vectors with the original one, and the mean of the best three."""
    sims = F.transform(generated, lambda v: numbers.cosine(original, v))
    return sims, numbers.top_mean(sims, 3)


def overall(components: DataFrame) -> DataFrame:
    """components (component, score): evidence quality is the mean of its parts that there are; a missing component counts
    nought. Gives component, weight, score, weighted_contribution, and OVERALL with its gate."""
    parts = components.groupBy().pivot("component", [*EVIDENCE, *[n for n, _ in WEIGHTS if n != "evidence_quality"]]).agg(F.first("score"))
    given = F.array(*[F.col(e) for e in EVIDENCE])
    there = F.filter(given, lambda x: x.isNotNull())
    evidence = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))
    value = {n: evidence if n == "evidence_quality" else F.col(n) for n, _ in WEIGHTS}
    rows = [F.struct(F.lit(n).alias("component"), F.lit(w).alias("weight"), value[n].alias("score"), (F.coalesce(value[n], F.lit(0.0)) * w).alias("weighted_contribution"), F.lit(None).cast("string").alias("gate")) for n, w in WEIGHTS]
    total = sum((F.coalesce(value[n], F.lit(0.0)) * w for n, w in WEIGHTS), F.lit(0.0))
    last = F.struct(F.lit("OVERALL").alias("component"), F.lit(1.0).alias("weight"), total.alias("score"), total.alias("weighted_contribution"), numbers.gate(total, *OVERALL_GATE).alias("gate"))
    return parts.select(F.inline(F.array(*rows, last)))


_CARDS = {
    "answer_relevancy": ("generated_question", "generated_question", lambda: F.col("cosine_similarity").cast("double"), lambda: F.lit("")),
    "context_precision": ("citation_id", "citation_id", lambda: text.is_true(F.col("is_relevant")).cast("double"), lambda: F.col("explanation")),
    "answer_source_traceability": ("claim_id", "claim_id", lambda: text.is_true(F.col("is_correct_source")).cast("double"), lambda: F.col("explanation")),
    "faithfulness": ("claim_id", "claim_id", lambda: text.is_true(F.col("is_correct_source")).cast("double"), lambda: F.col("explanation")),
    "target_validation": ("citation_id", None, lambda: text.is_true(F.col("is_correctly_extracted")).cast("double"), lambda: F.col("explanation")),
    "risk_peers_validation": ("company_name", None, lambda: text.is_true(F.col("is_semantically_relevant")).cast("double"), lambda: F.col("relevance_explanation")),
    "overall_score": ("component", "component", lambda: F.col("score").cast("double"), lambda: F.concat(F.lit("weight "), F.col("weight").cast("string"))),
}
TESTS = tuple(_CARDS)


def scorecard(rows: DataFrame, test: str) -> DataFrame:
    """dimension, score, note of a test's result rows; an unknown test gives none."""
    if test not in _CARDS:
        return rows.sparkSession.createDataFrame([], "dimension string, score double, note string")
    key, dimension, score, note = _CARDS[test]
    kept = rows.where(F.length(F.trim(F.coalesce(F.col(key), F.lit("")))) > 0)
    kept = kept.where(~F.trim(key).isin(*SUMMARY_MARKS))
    if test == "target_validation":
        named = F.concat(F.coalesce("type", F.lit("?")), F.lit(" · "), F.coalesce("extracted_name", F.lit("")))
    elif test == "risk_peers_validation":
        named = F.concat(F.coalesce("company_name", F.lit("")), F.lit(" · "), F.coalesce("risk_theme", F.lit("")))
    else:
        named = F.col(dimension)
    return kept.select(named.alias("dimension"), F.coalesce(score(), F.lit(0.0)).alias("score"), F.coalesce(note(), F.lit("")).alias("note"))


def weighted(rows: DataFrame, test: str) -> DataFrame:
    """The one score of a test: from its summary row, or from its rows."""
    marks = {"answer_relevancy": ("generated_question", "answer_relevancy_score"), "context_precision": ("citation_id", "is_relevant"), "overall_score": ("component", "score")}
    if test in marks:
        key, value = marks[test]
        return rows.where(F.trim(key).isin(*SUMMARY_MARKS)).agg(F.coalesce(F.first(F.col(value).try_cast("double")), F.lit(0.0)).alias("weighted"))
    if test in ("faithfulness", "answer_source_traceability"):
        return faithfulness(rows.withColumn("is_correct_source", text.is_true(F.col("is_correct_source")))).select(F.coalesce("score", F.lit(0.0)).alias("weighted"))
    return scorecard(rows, test).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("weighted"))


def with_summary(detail: DataFrame, summary: DataFrame) -> DataFrame:
    """For export only: detail rows, then the summary."""
    return detail.unionByName(summary, allowMissingColumns=True)


def chunk_lengths(rows: DataFrame, long: int = 8000) -> DataFrame:
    return rows.groupBy("verdict").agg(
        F.avg("length").alias("avg_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.count_if(F.col("length") > long).alias("n_long"), F.count("*").alias("n")
    )


def skip_reason(chunk: Column) -> Column:
    """Why a chunk isn't judged; null if it is."""
    return F.when(F.length(F.coalesce(chunk, F.lit(""))) == 0, "missing").when(text.word_count(chunk) < 10, "too short").when(F.length(chunk) > 15000, "too long")


def best_chunk(*candidates: Column) -> Column:
    """The first candidate of more than ten words."""
    return F.coalesce(*[F.when(text.word_count(c) > 10, c) for c in candidates], F.lit(""))


def source_or(source: Column, description: Column, why: Column, most: int = 6000) -> Column:
    """The source text unless it is short or a table of contents; then description and reason."""
    clean = text.strip(F.coalesce(source, F.lit("")))
    poor = (F.length(clean) < 80) | F.lower(clean).startswith("table of contents")
    return F.left(F.when(poor, F.concat_ws(" | ", text.blank_to_null(description), text.blank_to_null(why))).otherwise(clean), F.lit(most))


def metric_source(section: Column, page: Column, tag: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Section: "), text.blank_to_null(section)), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Tag: "), text.blank_to_null(tag)))
