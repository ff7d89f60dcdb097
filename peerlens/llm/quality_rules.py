"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document gets statistics of its words and lines, and each rule rejects documents whose statistic is above a cutoff.
The cutoffs come from the labelled documents, for each stratum (a value of `stratum`, e.g. the language). All rules tighten
together along one path that is fixed beforehand: first the loosest cutoff of the first rule, of the second, and so on, then
the next tighter one of each. At every step of the path an exact binomial test of the good documents that all rules
together would reject asks whether more than `alpha` of the good fall; the path is followed as long as the test rejects
that. As the steps are tested in a fixed order and the first failure ends it, no correction is needed within a stratum, and
the whole of `alpha` is there for the rules together; the level is `delta` over the number of strata (Bonferroni). So with
probability 1 - `delta` no stratum loses more than `alpha` of its good documents to the rules.

Even without a rejected good document a stratum needs log(delta / strata) / log(1 - alpha) good ones for a first cutoff
(152 for 5 strata and the parameters below); with fewer, only the base rules reject there.

Defined cases: a null or empty text has no words and fails the base rules; null strata form one stratum; repeated rows
are judged alike; a document with several labels counts as good only if all of them say so; with an empty label table
no cutoff is found, so only the base rules reject; an empty table gives no rows. A very long text is one row of arrays of
its words' hashes. Other columns are not touched, whatever their names, but that columns called like an added one are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose statistic is above the cutoff."""

    name: str
    grid: tuple[float, ...]


#: The statistics are in permille or plain counts, so that comparisons are exact in both engines.
RULES = (
    Rule("symbol_pm", (1, 2, 5, 10, 20, 50, 100, 200)),
    Rule("dup_line_pm", (50, 100, 150, 200, 300, 400, 600, 800)),
    Rule("repeat_pm", (10, 20, 50, 100, 150, 200, 250, 300)),
    Rule("short_word_pm", (3, 5, 10, 20, 50, 100, 200, 400)),
    Rule("upper_pm", (100, 150, 200, 300, 400, 500, 700, 900)),
    Rule("digit_pm", (10, 20, 50, 100, 200, 300, 400, 600)),
)


@dataclass(frozen=True)
class Params:
    alpha: float = 0.03
    delta: float = 0.05
    rules: Sequence[Rule] = field(default=RULES)
    stratum: str = "lang"


def _side_by_side(h: Column) -> Column:
    """Hash and place of every window, sorted so that equal windows become neighbours; null if all windows differ."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def _repeat_words(ordered: Column) -> Column:
    """Words that lie in a window which occurs twice or more."""
    marked = F.filter(
        ordered,
        lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | ((i + 1 < F.size(ordered)) & (F.get(ordered, i + 1)["h"] == x["h"])),
    )
    covered = F.aggregate(
        F.array_sort(F.transform(marked, lambda x: x["i"])),
        F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(8))).alias("n")),
        lambda a: a["n"],
    )
    return F.coalesce(covered, F.lit(0))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to docs, and what `also` names of
    n_lines, n_upper and n_digits. Such columns of docs are replaced."""
    added = (*STATISTICS, *also)
    # The columns of docs travel as one, so none can clash with those that are made on the way.
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("doc")
    body = docs.select(own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    words = F.filter(F.split("body", common.WORD_SPLIT), lambda w: w != "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def count(pattern: str) -> Column:
        return (F.length("body") - F.length(F.regexp_replace("body", pattern, ""))).cast("long")

    counts = {"n_upper": count("[A-Z]"), "n_digits": count("[0-9]")}
    first = body.select(
        "doc",
        F.transform(words, lambda w: F.xxhash64(w)).alias("w"),
        F.transform(lines, lambda x: F.md5(x.cast("binary"))).alias("lines"),
        F.length(F.regexp_replace("body", common.WORD_SPLIT, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        *[c.alias(name) for name, c in counts.items() if name in also],
    )
    windows = F.when(
        F.size("w") >= 8,
        F.transform(F.sequence(F.lit(0), F.size("w") - 8), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(8)])),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumns({"h": windows, "n_words": F.size("w").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_lines": F.size("lines").cast("long")})
    third = second.withColumn("o", _side_by_side(F.col("h")))
    return third.withColumn("n_repeat_words", _repeat_words(F.col("o")).cast("long")).select("doc.*", *added)


def rule_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The statistics that the rules compare, as whole permille: `symbol_pm` etc."""

    def share(part: Column, whole: Column) -> Column:
        return F.floor(part * 1000 / F.greatest(whole, F.lit(1)))

    extra = ("n_lines", "n_upper", "n_digits")
    own = docs.drop(*extra, *[r.name for r in RULES])
    return (
        statistics(own, text, extra)
        .withColumns(
            {
                "symbol_pm": share(F.col("n_symbols"), F.col("word_chars")),
                "dup_line_pm": share(F.col("n_dup_lines"), F.col("n_lines")),
                "repeat_pm": share(F.col("n_repeat_words"), F.col("n_words")),
                "short_word_pm": share(F.col("n_words"), F.col("word_chars")),
                "upper_pm": share(F.col("n_upper"), F.col("word_chars")),
                "digit_pm": share(F.col("n_digits"), F.col("word_chars")),
            }
        )
        .drop(*extra)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def tail(n: Column, k: Column, alpha: float) -> Column:
    """P(X <= k) for X of Bin(n, alpha), summed term by term in logarithms."""
    odds = math.log(alpha / (1 - alpha))
    start = F.struct((n * F.lit(math.log1p(-alpha))).cast("double").alias("log"), F.exp(n * F.lit(math.log1p(-alpha))).cast("double").alias("sum"))

    def step(a: Column, j: Column) -> Column:
        log = a["log"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda a: a["sum"])


def path(rules: Sequence[Rule]) -> list[tuple[Rule, float]]:
    """All steps: the loosest cutoff of every rule, then the next one of every rule, and so on."""
    grids = [(r, sorted(r.grid, reverse=True)) for r in rules]
    return [(r, g[k]) for k in range(max((len(g) for _, g in grids), default=0)) for r, g in grids if k < len(g)]


def first_step(rules: Sequence[Rule]) -> Column:
    """The number (from 0) of the first step at which a document is rejected; the number of all steps if it never is."""
    steps = path(rules)
    return F.least(F.lit(len(steps)), F.lit(len(steps)), *[F.when(F.col(r.name) > c, t) for t, (r, c) in enumerate(steps)])


def accepted_steps(stats: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """For each stratum with good documents: stratum, n_good, steps (how many of the path are safe) and n_rejected (good
    documents that fall then)."""
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).where("_quality = 1")
    rows = stats.where(~base_failed()).join(good, F.col("doc_id") == F.col("_id"))
    each = rows.select(F.coalesce(F.col(params.stratum), F.lit("")).alias("stratum"), first_step(params.rules).alias("step"))
    n = len(path(params.rules))
    fallen = F.array(*[F.count_if(F.col("step") <= t) for t in range(n)])
    counted = each.groupBy("stratum").agg(F.count("*").alias("n_good"), fallen.alias("fallen"))
    # One row, so it is broadcast.
    counted = counted.join(F.broadcast(counted.agg(F.count("*").alias("strata"))))

    # The test can only succeed below the expected number, which keeps the sum of terms short.
    def safe(k: Column) -> Column:
        return F.coalesce(F.when(k < F.col("n_good") * params.alpha, tail(F.col("n_good"), k, params.alpha) <= F.lit(params.delta) / F.col("strata")), F.lit(False))

    failed = F.array_position(F.transform("fallen", safe), F.lit(False))
    out = counted.withColumn("steps", F.when(failed > 0, failed - 1).otherwise(n).cast("int"))
    return out.select("stratum", "n_good", "steps", F.coalesce(F.get("fallen", F.col("steps") - 1), F.lit(0)).alias("n_rejected"))


def cutoffs(steps: DataFrame, params: Params = Params()) -> DataFrame:
    """accepted_steps as cutoffs: stratum, rule, cutoff, n_good, n_rejected, for each rule that has one."""
    taken = F.slice(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(float(c)).alias("cutoff")) for r, c in path(params.rules)]), F.lit(1), F.col("steps"))
    return steps.select("stratum", "n_good", "n_rejected", F.inline(taken)).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.first("n_good").alias("n_good"), F.first("n_rejected").alias("n_rejected"))


def apply_rules(stats: DataFrame, steps: DataFrame, params: Params = Params()) -> DataFrame:
    """Adds base_failed and kept. steps (of accepted_steps) is joined by stratum."""
    safe = steps.select(F.col("stratum").alias("_stratum"), F.col("steps").alias("_steps"))
    joined = stats.join(safe, F.coalesce(F.col(params.stratum), F.lit("")) == F.col("_stratum"), "left")
    fine = first_step(params.rules) >= F.coalesce("_steps", F.lit(0))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fine).drop("_stratum", "_steps")


def quality_rules(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for every row of docs."""
    lean = docs.select(F.col("doc_id"), F.col("text"), F.col(params.stratum))
    names = [r.name for r in params.rules]
    stats = common.stored(
        rule_statistics(lean).select("doc_id", params.stratum, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *names), "rules"
    )
    steps = common.stored(accepted_steps(stats, labels.select("doc_id", "quality"), params), "steps")
    return apply_rules(stats, steps, params).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
