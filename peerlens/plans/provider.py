"""Where the replies of language models come from: a recorded table, rules, or a function run over batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators.numbering import numbered
from .replies import answered, busy


class Provider(Protocol):
    def replies(self, prompts: DataFrame) -> DataFrame:
        """prompts (job_id, phase, idx, prompt) with reply."""


class Recorded:
    """Replies from a table (prompt, reply), by the whole prompt; null where there is none."""

    def __init__(self, table: DataFrame):
        self.table = table

    def replies(self, prompts: DataFrame) -> DataFrame:
        return answered(prompts, self.table)


class Rules:
    """Replies from a column expression over the prompts."""

    def __init__(self, rule: Column):
        self.rule = rule

    def replies(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("reply", self.rule)


class Live:
    """Replies from a function, in batches on the executors; throttled calls are tried again with growing waits."""

    def __init__(self, call: Callable[[str], str], tries: int = 5, wait: float = 1.0):
        self.call, self.tries, self.wait = call, tries, wait

    def replies(self, prompts: DataFrame) -> DataFrame:
        call, tries, wait = self.call, self.tries, self.wait

        def one(prompt: str) -> str:
            for n in range(1, tries + 1):
                try:
                    return call(prompt)
                except Exception as failed:
                    if n == tries or not busy(failed):
                        raise
                    time.sleep(wait * n)
            return ""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(reply=[one(p) for p in batch["prompt"]])

        return prompts.mapInPandas(run, prompts.select("*", F.lit("").alias("reply")).schema)


def numbered_prompt(head: str, item: Column, group: list[str], order: str, items: DataFrame) -> DataFrame:
    """One prompt for each group: the head, then its items as `[idx] text`."""
    line = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] "), item)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n")
    return items.groupBy(*group).agg(F.concat(F.lit(head + "\n\n"), listed).alias("prompt"), F.count("*").cast("int").alias("n"))


#: Items in a prompt of each phase, and what its prompts list together.
BATCH = {"1b": 30, "1": 30, "1c": 50, "2a": 50, "2b": 15, "risk 1": 50, "risk 2": 500}
GROUPS = {"1b": (), "1": ("chunk",), "1c": (), "2a": ("category",), "2b": (), "risk 1": ("chunk",), "risk 2": ()}
#: Phases in which an item alone isn't asked about.
SEVERAL = ("1", "2a", "risk 1", "risk 2")
HEADS = {
    "1b": "For each metric say whether it has a standard concept: KEEP, or REMOVE if there is none.",
    "1": "These metrics come from one text. KEEP, REMOVE, FIX or MERGE each.",
    "1c": "FIX the category of each metric that is in the wrong one.",
    "2a": "These metrics are in one category. MERGE those that say the same.",
    "2b": "These metrics of several categories report one value. MERGE those that say the same.",
    "risk 1": "These risks come from one text. KEEP, REMOVE or MERGE each.",
    "risk 2": "These risks come from several texts. MERGE those that say the same.",
}


def judged(rows: DataFrame, phase: str, provider: Provider, job: Sequence[str] = ("job_id",)) -> DataFrame:
    """Decisions of one phase: prompts of so many items of a group each, and what their replies say."""
    from ..operators import decisions

    group = [*job, *GROUPS[phase]]
    if phase == "2b":  # a batch holds groups of equal values, each of which is whole
        keyed = rows.withColumn("_key", numbers.value_key(F.col("value")))
        groups = decisions.cross_category_groups(rows, job).select(*job, "year", F.col("value_key").alias("_key"))
        dealt = keyed.join(numbered(groups, job, ["year", "_key"], "_n"), [*job, "year", "_key"])
    else:
        dealt = numbered(rows, group, ["idx"], "_n")
    dealt = dealt.withColumn("_batch", F.floor((F.col("_n") - 1) / BATCH[phase]).cast("int"))
    said = ("name", "description") if phase.startswith("risk") else ("name", F.concat(F.lit("= "), F.col("value").cast("string")), "unit", "category")
    prompts = numbered_prompt(HEADS[phase], F.concat_ws(" ", *said), [*group, "_batch"], "idx", dealt)
    if phase in SEVERAL:
        prompts = prompts.where("n > 1 or _batch > 0")
    # A prompt is named by its smallest idx.
    asked = prompts.withColumns({"phase": F.lit(phase), "idx": F.regexp_extract("prompt", r"(?m)^\[(\d+)\]", 1).cast("int")})
    return decisions.parse(provider.replies(asked).select(*job, "reply"), job=job)


def judged_passes(rows: DataFrame, provider: Provider, job: Sequence[str] = ("job_id",), keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """All passes over metrics, each with the provider's decisions on what the pass before left. keep (table, label) writes
    what is asked for twice, replies above all, and gives it back."""
    from ..operators import decisions

    out = rows
    for phase, step in decisions.PHASES.items():
        said = keep(judged(out, phase, provider, job), f"decisions-{phase}")
        out = keep(step(out, said, job=job), f"metrics-{phase}")
    return decisions.best_of_concept(out, job)
