"""Evaluations of answers: what is judged, in which batches, and the result rows that scorecards read.

Each takes a provider for the judge's replies. Result rows of a test are tables with the columns that `operators/scores.py`
knows; `with_mean` adds the summary row where the test has one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import batches, claims, facts, scores
from ..operators.numbering import numbered
from ..sources.shared import stored
from . import qa
from .provider import Provider, numbered_prompt

#: Items in a call of each test, questions that are made from an answer, characters of a source.
CALLS = {"context_precision": 20, "target_validation": 8, "risk_peers_validation": 10, "faithfulness": 10}
QUESTIONS, SOURCE_CHARS = 5, 600
PAIRS = "Answer each theme on a line of its own: chunk.theme, YES or NO, and why."
YES_NO = "Answer each item on a line of its own: its number, YES or NO, and why."


def yes_no(items: DataFrame, provider: Provider, test: str, head: str, item: Column, order: str, job: Sequence[str] = ("job_id",)) -> DataFrame:
    """items with verdict and explanation, judged in calls of as many as the test allows."""
    place = F.col("_n") - 1
    dealt = numbered(items, job, [order], "_n").withColumns({"batch": F.floor(place / CALLS[test]).cast("int"), "item": (place % CALLS[test] + 1).cast("int")}).drop("_n")
    asked = numbered_prompt(f"{head}\n{YES_NO}", item, [*job, "batch"], "item", dealt)
    asked = asked.select(*job, F.lit(test).alias("phase"), F.col("batch").alias("idx"), "prompt", "n", "batch")
    said = claims.verdicts(provider.replies(asked), [*job, "batch"])
    return dealt.join(said, [*job, "batch", "item"]).drop("batch", "item")


def context_precision(rows: DataFrame, question: str, provider: Provider, job: str) -> DataFrame:
    """citation_id, is_relevant, explanation of every source that was shown."""
    found = qa.chunks(rows).select(F.lit(job).alias("job_id"), "citation_id", "summary")
    out = yes_no(found, provider, "context_precision", f"Is each source relevant to the question: {question}", F.col("summary"), "citation_id")
    return out.select("citation_id", F.col("verdict").cast("string").alias("is_relevant"), "explanation")


def target_validation(rows: DataFrame, provider: Provider, job: str) -> DataFrame:
    """citation_id, type, extracted_name, is_correctly_extracted, explanation of the target's items."""
    found = qa.target_chunks(rows).withColumn("job_id", F.lit(job))
    item = F.concat_ws(" ", "extracted_name", "extracted_value", "extracted_unit", F.lit("from:"), F.left("source_text", F.lit(SOURCE_CHARS * 10)))
    out = None
    for kind in ("Risk", "Metric"):
        one = yes_no(found.where(F.col("type") == kind), provider, "target_validation", f"Is each {kind.lower()} what its source says?", item, "citation_id")
        out = one if out is None else out.unionByName(one)
    return out.select("citation_id", "type", "extracted_name", F.col("verdict").cast("string").alias("is_correctly_extracted"), "explanation")


def risk_calls(found: DataFrame, job: Sequence[str] = ("job_id",), most: int = CALLS["risk_peers_validation"]) -> DataFrame:
    """The evaluations (chunk_text, risk_theme, citation_id) with the call, chunk and theme numbers under which they are asked.
    Rows of one text are asked together, in slices of at most `most`; slices go to calls in the order of their texts' first
    rows, and a call takes slices while it has `most` evaluations or fewer."""
    text_of = F.sha2(F.col("chunk_text").cast("binary"), 256)
    # Rows of one citation and theme go by the company, so that equal inputs always get equal numbers.
    rows = numbered(found.withColumn("_text", text_of), [*job, "_text"], ["citation_id", "risk_theme", *[c for c in ("company", "cik") if c in found.columns]], "_n")
    rows = rows.withColumns({"_slice": F.floor((F.col("_n") - 1) / most), "theme": ((F.col("_n") - 1) % most + 1).cast("int")})
    # An evaluation's text comes once for each slice.
    slices = rows.groupBy(*job, "_text", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    first = rows.where("_n = 1").select(*job, "_text", F.col("citation_id").alias("_first"))
    dealt = batches.batched(slices.join(first, [*job, "_text"]), job, ["_first", "_text", "_slice"], "_size", batches.by_call(most), "call")
    placed = numbered(dealt, [*job, "call"], ["_first", "_text", "_slice"], "chunk").withColumn("chunk", F.col("chunk").cast("int"))
    return rows.join(placed.select(*job, "_text", "_slice", "call", "chunk"), [*job, "_text", "_slice"]).drop("_text", "_slice", "_n")


def risk_peers(rows: DataFrame, provider: Provider, job: str) -> DataFrame:
    """citation_id, company_name, risk_theme, is_semantically_relevant, relevance_explanation of peers' risks. A text is shown
    once with all themes that are said to come from it; texts that can't be judged say why."""
    found = qa.risk_chunks(rows).withColumn("job_id", F.lit(job))
    dealt = stored(risk_calls(found.where("skip_reason is null")), "calls")
    line = F.concat(F.col("chunk").cast("string"), F.lit("."), F.col("theme").cast("string"), F.lit(" "), "risk_theme")
    chunks = dealt.groupBy("job_id", "call", "chunk").agg(F.any_value("chunk_text").alias("t"), F.sort_array(F.collect_list(F.struct("theme", line.alias("line")))).alias("themes"))
    shown = F.concat(F.lit("Chunk "), F.col("chunk").cast("string"), F.lit("\n"), "t", F.lit("\n"), F.array_join(F.col("themes.line"), "\n"))
    asked = chunks.groupBy("job_id", F.col("call").cast("int").alias("idx")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", shown.alias("s")))), lambda x: x["s"]), "\n\n").alias("prompt"))
    asked = asked.withColumns({"phase": F.lit("risk_peers_validation"), "prompt": F.concat(F.lit(f"Does each text bear out its themes?\n{PAIRS}\n\n"), "prompt")})
    said = claims.pair_verdicts(provider.replies(asked), ["job_id", "idx"])
    said = said.select("job_id", F.col("idx").cast("long").alias("call"), "chunk", "theme", "verdict", "explanation")
    ok = dealt.join(said, ["job_id", "call", "chunk", "theme"], "left").drop("call", "chunk", "theme")
    ok = ok.withColumns({"verdict": F.coalesce("verdict", F.lit(False)), "explanation": F.coalesce("explanation", F.lit(claims.UNPARSED))})
    skipped = found.where("skip_reason is not null").withColumns({"verdict": F.lit(False), "explanation": F.concat(F.lit("Chunk "), "skip_reason")})
    both = ok.unionByName(skipped)
    return both.select("citation_id", F.col("company").alias("company_name"), "risk_theme", F.col("verdict").cast("string").alias("is_semantically_relevant"), F.col("explanation").alias("relevance_explanation"))


def faithfulness(answers: DataFrame, rows: DataFrame, provider: Provider, job: str) -> DataFrame:
    """claim_id, claim_text, used_source, correct_source, is_correct_source, explanation of every claim. answers: answer_id,
    answer."""
    sources = qa.registry(rows).select("citation_id", F.left("summary", F.lit(SOURCE_CHARS)).alias("summary"))
    found = claims.claims(answers, sources)
    dealt = numbered(found, ["answer_id"], ["claim_id"], "_n").withColumn("batch", F.floor((F.col("_n") - 1) / CALLS["faithfulness"]).cast("int")).drop("_n")
    shown = dealt.join(sources, F.col("resolved_citation") == F.col("citation_id"), "left")
    line = F.concat(F.lit("CLAIM_ID: "), "claim_id", F.lit("\n"), "claim_text", F.lit("\nUSED_SOURCE: "), "resolved_citation", F.lit("\n"), F.coalesce("summary", F.lit("")))
    asked = shown.groupBy("answer_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", line.alias("t")))), lambda x: x["t"]), "\n---\n").alias("prompt"))
    asked = asked.select(F.lit(job).alias("job_id"), F.lit("faithfulness").alias("phase"), F.col("batch").alias("idx"), "prompt", "answer_id")
    said = claims.attribution_blocks(provider.replies(asked), ["answer_id"], sources)
    return claims.attributed(found, said, ["answer_id"])


def answer_relevancy(answer: str, question: str, provider: Provider, embed: Callable[[Column], Column], job: str, prompts: DataFrame) -> DataFrame:
    """generated_question, cosine_similarity, answer_relevancy_score: questions made from the answer against the one that
    was asked, and the mean of the best three. prompts: one row, from which the call is made; embed: a text's vector."""
    asked = prompts.limit(1).select(F.lit(job).alias("job_id"), F.lit("answer_relevancy").alias("phase"), F.lit(0).alias("idx"), F.concat(F.lit(f"Write {QUESTIONS} questions, numbered, that this answers:\n"), F.lit(answer)).alias("prompt"))
    made = provider.replies(asked).select(text.numbered_lines(F.col("reply"), QUESTIONS).alias("questions"))
    vectors = made.select("questions", F.transform("questions", embed).alias("generated"), embed(F.lit(question)).alias("own"))
    sims, mean = scores.relevancy(F.col("own"), F.col("generated"))
    rows = vectors.select("questions", sims.alias("sims"), mean.alias("mean"))
    each = rows.select(F.inline(F.arrays_zip(F.col("questions").alias("generated_question"), F.col("sims").alias("cosine_similarity")))).withColumn("answer_relevancy_score", F.lit(None).cast("double"))
    return each.unionByName(rows.select(F.lit("** TOP-3 MEAN **").alias("generated_question"), F.lit(None).cast("double").alias("cosine_similarity"), F.col("mean").alias("answer_relevancy_score")))


def num_values(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """Peers' metrics against the facts that were reported: citation_id, cik, tag, year, value, unit, gt_value, match."""
    found = qa.peer_metric_items(rows).select("citation_id", "cik", F.col("xbrl_tag").alias("tag"), "year", "value", "unit")
    return facts.compare(found, facts.ground_truth(reported, found.select("cik", "tag", "year")))


def with_mean(rows: DataFrame, key: str, value: str, mark: str = "** MEAN **") -> DataFrame:
    """Result rows as text, and a summary row of the share of true values."""
    share = rows.agg(F.avg(text.is_true(F.col(value)).cast("double")).alias("m")).select(F.lit(mark).alias(key), F.format_string("%.6f", F.coalesce("m", F.lit(0.0))).alias(value))
    return scores.with_summary(rows, share)


@dataclass(frozen=True)
class Inputs:
    """What a test by name works on: the rows of a question, its question and answer (one row), results of tests that have
    run before (by name), a text's vector, and facts that were reported."""

    job: str
    rows: DataFrame | None
    said: DataFrame
    provider: Provider
    past: dict[str, DataFrame]
    embed: Callable[[Column], Column] | None = None
    reported: DataFrame | None = None

    def one(self) -> tuple[str, str]:
        r = self.said.first()
        return r["question"], r["answer"]


def _relevancy(given: Inputs) -> tuple[DataFrame, DataFrame]:
    if given.embed is None:
        raise ValueError("answer_relevancy needs a text's vector (embed)")
    question, answer = given.one()
    out = stored(answer_relevancy(answer, question, given.provider, given.embed, given.job, given.said), "relevancy")
    marked = F.col("generated_question").isin(*scores.SUMMARY_MARKS)
    return out.where(~marked), out.where(marked)


def _precision(given: Inputs) -> tuple[DataFrame, DataFrame]:
    out = stored(context_precision(given.rows, given.one()[0], given.provider, given.job), "precision")
    share = out.agg(F.avg(text.is_true(F.col("is_relevant")).cast("double")).alias("m"))
    return out, share.select(F.lit("** MEAN **").alias("citation_id"), F.format_string("%.6f", F.coalesce("m", F.lit(0.0))).alias("is_relevant"))


def _alone(detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    detail = stored(detail, "results")
    return detail, detail.limit(0)


def components(given: Inputs) -> DataFrame:
    """component, score of the tests that have run: those that scores.overall() weighs."""
    names = {"risk_peers_validation": "risks_validation", "target_validation": "target_validation", "answer_source_traceability": "faithfulness", "context_precision": "context_precision", "answer_relevancy": "answer_relevancy", "num_values": "metrics_validation"}
    empty = given.said.sparkSession.createDataFrame([], "component string, score double")
    out = empty
    for test, name in names.items():
        if test not in given.past:
            continue
        rows = given.past[test]
        one = facts.match_counts(rows).select(F.col("accuracy").alias("weighted")) if test == "num_values" else scores.weighted(rows, test)
        out = out.unionByName(one.select(F.lit(name).alias("component"), F.col("weighted").alias("score")))
    return out


def _recall(given: Inputs) -> tuple[DataFrame, DataFrame]:
    """Mean of the parts of evidence that there are."""
    parts = components(given).where(F.col("component").isin(*scores.EVIDENCE))
    return parts, parts.agg(F.avg("score").alias("score")).select(F.lit("** MEAN **").alias("component"), "score")


def _overall(given: Inputs) -> tuple[DataFrame, DataFrame]:
    out = stored(scores.overall(components(given)), "overall")
    last = F.col("component") == "OVERALL"
    return out.where(~last), out.where(last).withColumn("component", F.lit("** OVERALL **"))


#: Tests by name: detail rows and a summary row, if the test has one.
BY_NAME: dict[str, Callable[[Inputs], tuple[DataFrame, DataFrame]]] = {
    "answer_relevancy": _relevancy,
    "context_precision": _precision,
    "answer_source_traceability": lambda g: _alone(faithfulness(g.said.select(F.lit(g.job).alias("answer_id"), "answer"), g.rows, g.provider, g.job)),
    "context_recall": _recall,
    "target_validation": lambda g: _alone(target_validation(g.rows, g.provider, g.job)),
    "risk_peers_validation": lambda g: _alone(risk_peers(g.rows, g.provider, g.job)),
    "num_values": lambda g: _alone(num_values(g.rows, g.reported)),
    "overall_score": _overall,
}
