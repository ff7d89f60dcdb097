"""Decisions of a judge as a table (idx, action, merge_into, value, unit, gaap_concept, category, reason), and what
they do to entities. An entity without a decision is kept. An idx counts within its job: `job` names the columns, if entities
and decisions of several jobs (companies) come together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from . import batches
from .numbering import numbered

SCHEMA = "idx int, action string, merge_into int, value string, unit string, gaap_concept string, category string, reason string"


def parse(replies: DataFrame, reply: str = "reply", job: Sequence[str] = ()) -> DataFrame:
    """A row for each decision with an idx in the replies; the last one of an idx counts."""
    rows = replies.select(*[c for c in replies.columns if c != reply], F.posexplode(text.json_array(F.col(reply), text.struct_of(SCHEMA))).alias("_pos", "_d"))
    rows = rows.select(*[c for c in rows.columns if c not in ("_pos", "_d")], "_pos", "_d.*").where("idx is not null")
    w = Window.partitionBy(*job, "idx").orderBy(F.desc("_pos"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_pos")


def decided(entities: DataFrame, decisions: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    """entities with columns d_action etc. of their decision."""
    key = [*job, "idx"]
    own = decisions.select(*key, *[F.col(c).alias(f"d_{c}") for c in decisions.columns if c not in key])
    return entities.join(own, key, "left").withColumn("d_action", F.upper(F.coalesce("d_action", F.lit("KEEP"))))


def apply_merges(entities: DataFrame, decisions: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    """Those kept, those that others merge into, and those whose target doesn't exist. Merging goes one step, and any
    other action drops the entity unless another merges into it."""
    both = decided(entities, decisions.select(*job, "idx", "action", "merge_into"), job)
    known = entities.select(*job, F.col("idx").alias("target"), F.lit(True).alias("found"))
    wanted = both.where(F.col("d_action").isin("KEEP", "MERGE")).select(*job, "idx", F.when(F.col("d_action") == "MERGE", F.coalesce("d_merge_into", "idx")).otherwise(F.col("idx")).alias("target"))
    stay = wanted.join(known, [*job, "target"], "left").select(*job, F.when(F.col("found"), F.col("target")).otherwise(F.col("idx")).alias("idx")).distinct()
    return entities.join(stay, [*job, "idx"], "left_semi")


def within_chunk(entities: DataFrame, decisions: DataFrame, group: str = "chunk", fix: tuple[str, ...] = ("value", "unit", "gaap_concept"), job: Sequence[str] = ()) -> DataFrame:
    """Per chunk: REMOVE drops, FIX overwrites, MERGE keeps the target even if it is removed; a chunk's only entity is
    never judged."""
    size = F.count("*").over(Window.partitionBy(*job, group))
    sized = decided(entities, decisions, job).withColumn("_size", size)
    alone = sized.where("_size = 1").select(*entities.columns)
    judged = sized.where("_size > 1")
    peers = judged.select(*job, group, F.col("idx").alias("_target"), F.lit(True).alias("_found"))
    merges = judged.where("d_action = 'MERGE'").withColumn("_target", F.coalesce("d_merge_into", "idx")).join(peers, [*job, group, "_target"], "left")
    stay = judged.where(~F.col("d_action").isin("REMOVE", "MERGE")).select(*job, "idx").unionByName(merges.select(*job, F.when(F.col("_found"), F.col("_target")).otherwise(F.col("idx")).alias("idx"))).distinct()
    fixed = {c: F.when((F.col("d_action") == "FIX") & (F.length(F.col(f"d_{c}")) > 0), F.col(f"d_{c}")).otherwise(F.col(c)) for c in fix if c in entities.columns}
    return judged.join(stay, [*job, "idx"], "left_semi").withColumns(fixed).select(*entities.columns).unionByName(alone)


def gaap_mapped(entities: DataFrame, decisions: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    """Without those that have no standard concept."""
    both = decided(entities, decisions, job)
    return both.where((F.lower(text.strip(F.coalesce("gaap_concept", F.lit("")))) != "no gaap") & (F.col("d_action") != "REMOVE")).select(*entities.columns)


def categories_fixed(entities: DataFrame, decisions: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    both = decided(entities, decisions, job)
    return both.withColumn("category", F.when((F.col("d_action") == "FIX") & (F.length("d_category") > 0), F.col("d_category")).otherwise(F.col("category"))).select(*entities.columns)


def per_category(entities: DataFrame, decisions: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    """Merges within categories of two entities or more; those without a category pass."""
    named = F.when(F.length("category") > 0, F.col("category"))
    # Counted in a partial aggregation and joined, as there are few categories and many entities in each.
    sizes = entities.groupBy(*job, named.alias("_category")).agg((F.count("*") > 1).alias("_several")).where("_category is not null")
    sized = entities.withColumn("_category", named).join(sizes, [*job, "_category"], "left").withColumn("_judged", F.coalesce("_several", F.lit(False)))
    judged = apply_merges(sized.where("_judged").select(*entities.columns), decisions, job)
    return sized.where(~F.col("_judged")).select(*entities.columns).unionByName(judged)


def cross_category_groups(entities: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    """year, value_key, n, n_categories of values that several categories report."""
    keyed = entities.select(*job, "year", "category", numbers.value_key(F.col("value")).alias("value_key")).where("value_key is not null")
    return keyed.groupBy(*job, "year", "value_key").agg(F.count("*").alias("n"), F.count_distinct("category").alias("n_categories")).where("n > 1 and n_categories > 1")


def cross_category(entities: DataFrame, decisions: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    keyed = entities.withColumn("_key", numbers.value_key(F.col("value")))
    groups = cross_category_groups(entities, job).select(*job, "year", F.col("value_key").alias("_key"), F.lit(True).alias("_judged"))
    marked = keyed.join(groups, [*job, "year", "_key"], "left")
    judged = apply_merges(marked.where("_judged").select(*entities.columns), decisions, job)
    return marked.where("_judged is null").select(*entities.columns).unionByName(judged)


#: Words of a concept that say nothing.
WEAK_WORDS = ("", "loss", "and", "or", "of", "the")


def _word_set(c: Column) -> Column:
    return F.array_distinct(F.split(F.lower(c), r"(?U)\W+"))


def best_of_concept(entities: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    """Of those with one concept and year the one whose type shares most words with it; ties to the earlier idx. Those
    without a concept stay."""
    concept = text.strip(F.coalesce("gaap_concept", F.lit("")))
    has = (concept != "") & (F.lower(concept) != "no gaap")
    score = F.size(F.array_intersect(F.array_except(_word_set(concept), F.array(*map(F.lit, WEAK_WORDS))), _word_set(F.coalesce("metric_type", F.lit("")))))
    w = Window.partitionBy(*job, F.lower(concept), text.strip(F.coalesce("year", F.lit("")))).orderBy(score.desc(), "idx")
    best = entities.where(has).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best.unionByName(entities.where(~has))


#: The passes over metrics, in order, by phase.
PHASES = {"1b": gaap_mapped, "1": within_chunk, "1c": categories_fixed, "2a": per_category, "2b": cross_category}


def metric_passes(entities: DataFrame, decisions: dict[str, DataFrame], job: Sequence[str] = ()) -> DataFrame:
    """All passes in order; decisions by phase (1b, 1, 1c, 2a, 2b)."""
    out = entities
    for phase, judged in PHASES.items():
        out = judged(out, decisions[phase], job=job)
    return best_of_concept(out, job)


def risk_passes(entities: DataFrame, decisions: dict[str, DataFrame], job: Sequence[str] = ()) -> DataFrame:
    return apply_merges(within_chunk(entities, decisions["1"], fix=(), job=job), decisions["2"], job)


def chosen_industry(candidates: DataFrame, valid: DataFrame, choice: DataFrame) -> DataFrame:
    """Of the distinct codes (code, seq) that are valid: the only one, or the one whose number (choice: n) is given.
    Fails if there is none or the number is out of range."""
    first = candidates.groupBy("code").agg(F.min("seq").alias("seq")).join(valid.select("code"), "code", "left_semi")
    listed = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("codes"), F.count("*").alias("n_codes"))
    picked = listed.join(F.broadcast(choice.select("n").limit(1)), how="left")
    out_of_range = F.col("n").isNull() | (F.col("n") < 1) | (F.col("n") > F.col("n_codes"))
    code = (
        F.when(F.col("n_codes") == 0, F.raise_error(F.lit("no valid industry code")))
        .when(F.col("n_codes") == 1, F.get("codes", F.lit(0))["code"])
        .when(out_of_range, F.raise_error(F.lit("the chosen number is out of range")))
        .otherwise(F.get("codes", F.col("n") - 1)["code"])
    )
    return picked.select(code.alias("code"))


def fixed_batches(df: DataFrame, size: int, order: str = "idx", group: str | None = None) -> DataFrame:
    """batch and position in it, counted from 0."""
    place = F.col("_n") - 1
    out = numbered(df, [group] if group else [], [order], "_n")
    return out.withColumn("batch", F.floor(place / size).cast("int")).withColumn("pos", (place % size).cast("int")).drop("_n")


def size_batches(lengths: Column, least: int = 5000) -> Column:
    """Batch numbers of consecutive lengths: a batch closes when it has `least`; an item that long is a batch alone."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, n: Column) -> Column:
        big = n >= least
        own = F.when(big & (a["held"] > 0), a["batch"] + 1).otherwise(a["batch"])
        held = F.when(big, F.lit(0)).otherwise(a["held"] + n)
        closed = big | (held >= least)
        return F.struct(F.when(closed, own + 1).otherwise(own).alias("batch"), F.when(closed, F.lit(0)).otherwise(held).alias("held"), F.concat(a["out"], F.array(own)).alias("out"))

    return F.aggregate(lengths, start, step, lambda a: a["out"])


def sliced_calls(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str, most: int = 10) -> DataFrame:
    """item, start, n, call of each group's items, in order: those with more than `most` evaluations are cut into slices, and
    the slices dealt to calls. A group may have any number of items."""
    n = F.col(size).cast("int")
    placed = numbered(df.select(*group, *order, size), group, order, "_n").where(n > 0)
    cut = placed.select(*group, (F.col("_n") - 1).cast("int").alias("item"), n.alias("_size"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(most))).alias("start"))
    slices = cut.select(*group, "item", "start", F.least(F.lit(most), F.col("_size") - F.col("start")).alias("n"))
    return batches.batched(slices, group, ["item", "start"], "n", batches.by_call(most), "call").withColumn("call", F.col("call").cast("int"))


def call_batches(sizes: Column, most: int = 10) -> Column:
    """Call numbers of consecutive items, each with so many evaluations: a call takes items while it has `most` or fewer."""
    start = F.struct(F.lit(0).alias("call"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, n: Column) -> Column:
        full = (a["held"] > 0) & (a["held"] + n > most)
        own = F.when(full, a["call"] + 1).otherwise(a["call"])
        return F.struct(own.alias("call"), F.when(full, n).otherwise(a["held"] + n).alias("held"), F.concat(a["out"], F.array(own)).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])
