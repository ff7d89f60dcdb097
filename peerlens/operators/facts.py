"""Selection and matching of reported facts: (cik, taxonomy, tag, unit, end, val, fy, fp, form, filed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from .dedup import first_of

#: The order in which taxonomies are tried, and the forms of annual reports.
TAXONOMIES = ("us-gaap", "dei", "ifrs-full", "srt")
ANNUAL = ("10-K", "10-K/A")


def explode_facts(docs: DataFrame) -> DataFrame:
    """From rows (cik, facts map of taxonomy to map of tag to its content): one row for each entry."""
    tags = docs.select("cik", F.explode("facts").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "content"))
    content = [F.col("content.label").alias("label"), F.col("content.description").alias("description")]
    # A map read from JSON keeps the order of the document.
    units = tags.select("cik", "taxonomy", "tag", *content, F.posexplode("content.units").alias("unit_ord", "unit", "entries"))
    return units.select("cik", "taxonomy", "tag", "label", "description", "unit", "unit_ord", F.inline("entries"))


def in_fiscal_year(facts: DataFrame, fy: Column | int) -> DataFrame:
    """Annual facts of 10-K forms that end within the fiscal year."""
    year = F.lit(fy) if isinstance(fy, int) else fy
    first, last = numbers.fiscal_window(year)
    return facts.where((F.col("fp") == "FY") & (F.col("form") == "10-K") & F.col("end").cast("date").between(first, last))


def latest(facts: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    return first_of(facts, keys, [F.col("end").desc(), *tie])


def preferred_taxonomy(facts: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first taxonomy, in the fixed order, that has the key."""
    place = F.array_position(F.array(*map(F.lit, TAXONOMIES)), F.col("taxonomy"))
    known = facts.withColumn("_place", place).where("_place > 0")
    w = Window.partitionBy(*keys)
    return known.withColumn("_best", F.min("_place").over(w)).where("_place = _best").drop("_place", "_best")


def preferred_unit(facts: DataFrame, keys: list[str], unit: str = "USD", order: str = "unit_ord") -> DataFrame:
    """All rows in the wanted unit, else in the first other one: by the order of the document, where facts have that
    column, then by name."""
    w = Window.partitionBy(*keys)
    first = [F.col(order).alias("ord")] if order in facts.columns else []
    rank = F.struct((F.col("unit") != unit).alias("other"), *first, F.col("unit").alias("name"))
    return facts.withColumn("_best", F.min(rank).over(w)).where(F.col("unit") == F.col("_best.name")).drop("_best")


def preferred(facts: DataFrame, keys: list[str], unit: str = "USD", order: str = "unit_ord") -> DataFrame:
    """preferred_unit of preferred_taxonomy, in one window: the best unit is that of the best taxonomy."""
    place = F.array_position(F.array(*map(F.lit, TAXONOMIES)), F.col("taxonomy"))
    first = [F.col(order).alias("ord")] if order in facts.columns else []
    rank = F.struct(F.col("_place").alias("place"), (F.col("unit") != unit).alias("other"), *first, F.col("unit").alias("name"))
    known = facts.withColumn("_place", place).where("_place > 0")
    best = known.withColumn("_best", F.min(rank).over(Window.partitionBy(*keys)))
    return best.where((F.col("_place") == F.col("_best.place")) & (F.col("unit") == F.col("_best.name"))).drop("_place", "_best")


def ground_truth(facts: DataFrame, wanted: DataFrame, unit: str = "USD") -> DataFrame:
    """For each wanted (cik, tag, year): the entry with the latest end, then filing, of an annual report of that year."""
    chosen = preferred(facts, ["cik", "tag"], unit)
    annual = chosen.where(F.col("form").isin(*ANNUAL))
    hit = annual.join(wanted.select("cik", "tag", F.col("year").cast("string").alias("year")).distinct(), ["cik", "tag"])
    hit = hit.where((F.col("fy").cast("string") == F.col("year")) | (F.substring(F.col("end").cast("string"), 1, 4) == F.col("year")))
    return first_of(hit, ["cik", "tag", "year"], [F.col("end").desc(), F.col("filed").desc(), F.col("val")])


def compare(ours: DataFrame, truth: DataFrame) -> DataFrame:
    """ours (cik, tag, year, value, unit) with gt_value, gt_unit, gt_filed and match: MATCH, MISMATCH, NOT_FOUND or ERROR."""
    t = truth.select("cik", "tag", "year", F.col("val").alias("gt_value"), F.col("unit").alias("gt_unit"), F.col("filed").alias("gt_filed"))
    both = ours.join(t, ["cik", "tag", "year"], "left")
    number = numbers.scaled(F.col("value").cast("string"), F.col("unit"))
    status = (
        F.when((F.length(F.coalesce(F.col("cik").cast("string"), F.lit(""))) == 0) | F.col("tag").isNull(), "ERROR")
        .when(F.col("gt_value").isNull(), "NOT_FOUND")
        .when(numbers.values_match(number, F.col("gt_value")), "MATCH")
        .otherwise("MISMATCH")
    )
    return both.withColumn("match", status)


def match_counts(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, accuracy (of those found) and score (of all)."""
    match, miss = F.count_if(F.col("match") == "MATCH"), F.count_if(F.col("match") == "MISMATCH")
    return compared.groupBy(*(by or [])).agg(
        match.alias("n_match"),
        miss.alias("n_mismatch"),
        F.count_if(F.col("match") == "NOT_FOUND").alias("n_not_found"),
        F.count_if(F.col("match") == "ERROR").alias("n_error"),
        F.try_divide(match, match + miss).alias("accuracy"),
        F.try_divide(match, F.count("*")).alias("score"),
    )


def first_hit(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """candidates (metric_type, source_rank, ordinal, tag) against facts (cik, tag, ...): for each company and metric all
    facts of the first tag that has any."""
    joined = candidates.join(facts, "tag")
    w = Window.partitionBy("cik", "metric_type")
    rank = F.struct("source_rank", "ordinal")
    return joined.withColumn("_best", F.min(rank).over(w)).where(rank == F.col("_best")).drop("_best")


def last_taxonomy(facts: DataFrame) -> DataFrame:
    """Rows of the last taxonomy (by ord) that has the tag."""
    w = Window.partitionBy("cik", "tag")
    return facts.withColumn("_last", F.max("ord").over(w)).where("ord = _last").drop("_last")


def accepted_peers(metrics: DataFrame, risks: DataFrame, most: int = 3, least_risks: int = 7, above_words: int = 4800) -> DataFrame:
    """The first peers, by seq, that have metrics, at least so many risks and more than so many words."""
    has = metrics.groupBy("cik").agg(F.count("*").alias("n_metrics"))
    ok = risks.where((F.col("risk_count") >= least_risks) & (F.col("words") > above_words))
    return ok.join(has, "cik").orderBy("seq").limit(most)


def candidates(hits: DataFrame) -> DataFrame:
    """Search hits (seq, id, form, cik, adsh, ...): valid ones, one for each cik, in order."""
    valid = hits.where((F.col("form") == "10-K") & (F.length("cik") > 0) & F.col("id").contains(":") & (F.length("adsh") > 0))
    return first_of(valid, ["cik"], ["seq"]).orderBy("seq")
