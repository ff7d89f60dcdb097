"""What is done to a relation's extracted entities before they count: validators, found by the relation's name.

A validator takes the extracted rows and a Run, and gives the rows that stay. Rules of a user go in by `validator(name)`, or
with the relation itself (Relation.validate), which comes first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, text
from ..operators import decisions, dedup
from .provider import Provider, judged, judged_passes

Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Run:
    """What validators may use: the provider; keep (table, label), which writes a table and gives it back; codes (industry,
    code) of industries, and known, which gives those of the codes (code) that exist."""

    spark: SparkSession
    job: str
    company: str
    provider: Provider
    keep: Keep
    codes: DataFrame | None = None
    known: Callable[[DataFrame], DataFrame] = field(default=lambda codes: codes)


Validator = Callable[[DataFrame, Run], DataFrame]
_validators: dict[str, Validator] = {}


def validator(name: str) -> Callable[[Validator], Validator]:
    def add(f: Validator) -> Validator:
        _validators[name] = f
        return f

    return add


def validated(kind: entities.Relation, rows: DataFrame, run: Run) -> DataFrame:
    """Rows as they are where the relation has no validator."""
    own = kind.validate or _validators.get(kind.name)
    return own(rows, run) if own else rows


@validator("HAS_METRIC")
def metrics(rows: DataFrame, run: Run) -> DataFrame:
    """One of each name and year, then all passes over metrics, each with the replies to what the pass before left."""
    once = dedup.metrics(rows).withColumns({"job_id": F.lit(run.job), "idx": F.col("seq").cast("int"), "chunk": text.chunk_id(F.col("chunk_text"))})
    return judged_passes(run.keep(once, "metrics-once"), run.provider, keep=run.keep).drop("job_id")


@validator("FACES_RISK")
def risks(rows: DataFrame, run: Run) -> DataFrame:
    """One of each name, then merges within texts and over texts; a single risk isn't asked about."""
    once = dedup.risks(rows).withColumns({"job_id": F.lit(run.job), "idx": F.col("seq").cast("int"), "chunk": text.chunk_id(F.col("chunk_text"))})
    once = run.keep(once, "risks-once")
    said = run.keep(judged(once, "risk 1", run.provider), "decisions-risk-1")
    left = run.keep(decisions.within_chunk(once, said, fix=(), job=["job_id"]), "risks-1")
    said = run.keep(judged(left, "risk 2", run.provider), "decisions-risk-2")
    return decisions.apply_merges(left, said, ["job_id"]).drop("job_id")


@validator("OPERATES_IN")
def industries(rows: DataFrame, run: Run) -> DataFrame:
    """The one industry with a code that exists: the only one, or that whose number the provider names. The row gets `sic`.
    Fails if there is none; without a table of codes all industries stay, without codes."""
    if run.codes is None:
        return rows.withColumn("sic", F.lit(None).cast("struct<code:string,industry:string,sector:string>"))
    key = F.lower(F.trim("industry"))
    table = run.codes.select(key.alias("_key"), "code").dropDuplicates(["_key"])
    coded = rows.withColumn("_key", key).join(table, "_key").drop("_key")
    first = run.keep(dedup.first_of(coded, ["code"], ["seq"]), "industries")
    there = run.keep(run.known(first.select("code").distinct()), "codes")
    good = first.join(there.select("code"), "code", "left_semi")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", "code", "industry", "sector").alias("t")))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n")
    head = f"Which of these industries is the main one of {run.company}? Answer with its number.\n\n"
    asked = good.agg(F.count(F.lit(1)).alias("n"), listed.alias("t")).where("n > 1")
    asked = asked.select(F.lit(run.job).alias("job_id"), F.lit("OPERATES_IN choice").alias("phase"), F.lit(0).alias("idx"), F.concat(F.lit(head), "t").alias("prompt"))
    number = F.regexp_extract(text.without_thinking(F.col("reply")), r"(\d+)", 1).try_cast("int")
    said = run.keep(run.provider.replies(asked).select(number.alias("n")), "choice")
    chosen = decisions.chosen_industry(first.select("code", "seq"), there, said)
    return first.join(chosen, "code", "left_semi").withColumn("sic", F.struct("code", "industry", "sector")).drop("code")
