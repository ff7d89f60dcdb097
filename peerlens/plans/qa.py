"""From the rows of a question to what a model is shown, and back to cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import dedup

#: Fixed values.
ITEM_KEYS = ("risk_id", "gaap_concept", "name", "xbrl_tag")
PRIVATE = ("source_text", "cik")
CONTEXT_ROWS, REASONING_ROWS = 100, 150
LISTS = (("target_risks", "Risk", "target"), ("target_metrics", "Metric", "target"), ("peer_risks", "Risk", "peer"), ("peer_metrics", "Metric", "peer"))


def _mapped(c: Column, kind: T.DataType, leaf) -> Column:
    """Applies leaf to every string, however deep, and drops private fields."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _mapped(x, kind.elementType, leaf))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_mapped(c[f.name], f.dataType, leaf).alias(f.name) for f in kind.fields if f.name not in PRIVATE]))
    return leaf(c) if isinstance(kind, T.StringType) else c


def cleaned(df: DataFrame) -> DataFrame:
    """Without source texts and CIKs, at every depth."""
    return df.select(*[_mapped(F.col(f.name), f.dataType, lambda c: c).alias(f.name) for f in df.schema.fields if f.name not in PRIVATE])


def shortened(df: DataFrame, most: int = 400) -> DataFrame:
    """Strings of more than `most` characters are cut, at every depth."""
    return df.select(*[_mapped(F.col(f.name), f.dataType, lambda c: text.truncated(c, most)).alias(f.name) for f in df.schema.fields])


def deduplicated(rows: DataFrame, order: str = "seq") -> DataFrame:
    return dedup.nested(rows, [n for n, _, _ in LISTS if n in rows.columns], ITEM_KEYS, order)


def _shown(rows: DataFrame, most: int, order: str, whole: bool) -> DataFrame:
    """The first rows, and of each what is shown. They are found by their order alone, so whole rows stay where they are."""
    first = rows.select(F.col(order).alias("_first")).orderBy("_first").limit(most).groupBy("_first").agg(F.count(F.lit(1)).alias("_most"))
    same = Window.partitionBy(order).orderBy(order)
    found = rows.join(F.broadcast(first), F.col(order).eqNullSafe(F.col("_first")))
    small = cleaned(found.withColumn("_n", F.row_number().over(same)).where("_n <= _most").select(*rows.columns))
    small = small if whole else shortened(small)
    return small.select(F.struct(order, F.struct(*[c for c in small.columns if c != order]).alias("row")).alias("shown"))


def context_lines(rows: DataFrame, most: int = CONTEXT_ROWS, order: str = "seq", whole: bool = False) -> DataFrame:
    """The first rows, each as JSON, in order of the column of that name; long strings cut unless whole. For rows of any size."""
    small = _shown(rows, most, order, whole)
    return small.select(F.col(f"shown.{order}").alias(order), F.to_json("shown").alias("line"))


def context(rows: DataFrame, most: int = CONTEXT_ROWS, order: str = "seq", whole: bool = False) -> DataFrame:
    """One row with the first rows as one JSON text, for a prompt; long strings cut unless whole."""
    return _shown(rows, most, order, whole).agg(F.to_json(F.array_sort(F.collect_list("shown")), {"pretty": "true"}).alias("context"))


def items(rows: DataFrame, order: str = "seq") -> DataFrame:
    """citation_id, type, role, company, and the item's fields, of all lists; ordered by list, row and place (ord)."""
    out = None
    for k, (name, kind, role) in enumerate(LISTS):
        if name not in rows.columns:
            continue
        company = F.col("target") if role == "target" else F.col("peer")
        fields = {f.name for f in rows.schema[name].dataType.elementType.fields}
        get = lambda f: (F.col(f"item.{f}").cast("string") if f in fields else F.lit(None).cast("string")).alias(f)  # noqa: B023, E731
        wanted = ("citation_id", "name", "description", "why", "label", "value", "unit", "year", "gaap_concept", "xbrl_tag", "source_url", "document_url", "source_page", "section_title", "source_text", "risk_id")
        one = rows.select(order, company.alias("company"), F.posexplode(name).alias("pos", "item")).select(
            F.lit(kind).alias("type"), F.lit(role).alias("role"), "company", F.struct(F.col(order).alias("row"), F.lit(k).alias("list"), "pos").alias("ord"), *[get(f) for f in wanted]
        )
        out = one if out is None else out.unionByName(one)
    return out.where(F.length(F.coalesce("citation_id", F.lit(""))) > 0)


def summary() -> Column:
    metric = text.metric_summary(F.coalesce("label", "name"), F.col("value"), F.col("unit"), F.col("year"))
    return F.when(F.col("type") == "Metric", metric).otherwise(text.risk_summary(F.col("name"), F.col("description")))


def registry(rows: DataFrame) -> DataFrame:
    """All sources by citation_id; the last write counts."""
    w = Window.partitionBy("citation_id").orderBy(F.desc("ord"))
    return items(rows).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("summary", summary())


def registry_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("type", "role").agg(F.count("*").alias("n"))


def chunks(rows: DataFrame) -> DataFrame:
    """Sources to be judged: the first write counts, and of metrics also one for each company and concept."""
    first = Window.partitionBy("citation_id").orderBy("ord")
    once = items(rows).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    concept = F.coalesce("gaap_concept", "label", "name")
    same = Window.partitionBy("type", "company", F.when(F.col("type") == "Metric", concept).otherwise(F.col("citation_id"))).orderBy("ord")
    return once.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n").withColumn("summary", summary())


def citation_map(rows: DataFrame) -> DataFrame:
    """citation_id, type, company, role, document_url, source_page, section_title, summary; the first write counts, empty
    values are null."""
    w = Window.partitionBy("citation_id").orderBy("ord")
    first = items(rows).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    url = F.coalesce(text.blank_to_null(F.col("document_url")), text.blank_to_null(F.col("source_url")))
    return first.select("citation_id", "type", "company", "role", url.alias("document_url"), text.blank_to_null(F.col("source_page")).alias("source_page"), text.blank_to_null(F.col("section_title")).alias("section_title"), summary().alias("summary"))


def enriched(citations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Pages and sections of metrics that the citations lack, from the graph or from its metadata text."""
    meta = lambda f: F.get_json_object("metadata", f"$.{f}")
    m = metrics.select(F.col("citation_id"), F.coalesce("source_page", meta("source_page")).alias("_page"), F.coalesce("section_title", meta("section_title")).alias("_section"))
    both = citations.join(m, "citation_id", "left")
    return both.withColumns({"source_page": F.coalesce("source_page", "_page"), "section_title": F.coalesce("section_title", "_section")}).drop("_page", "_section")


def cited_order(answer: DataFrame, key: str = "answer_id", column: str = "answer") -> DataFrame:
    """citation_id and its number in order of first appearance."""
    found = answer.select(key, F.posexplode(text.citations(F.col(column))).alias("pos", "citation_id"))
    first = found.groupBy(key, "citation_id").agg(F.min("pos").alias("first"))
    return first.select(key, "citation_id", F.dense_rank().over(Window.partitionBy(key).orderBy("first")).alias("number"))


def peer_metric_items(rows: DataFrame) -> DataFrame:
    """Peers' metrics that can be checked: those with a tag and a CIK in their link, once for each citation."""
    from ..functions.numbers import cik_of_url

    w = Window.partitionBy("citation_id").orderBy("ord")
    found = items(rows).where("type = 'Metric' and role = 'peer'").withColumn("cik", cik_of_url(F.col("source_url")))
    return found.where(F.col("cik").isNotNull() & (F.length("xbrl_tag") > 0)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def risk_chunks(rows: DataFrame) -> DataFrame:
    """Peers' risks with the text to judge and why one isn't judged; nothing is dropped as a repeat."""
    from ..operators import scores

    found = items(rows).where("type = 'Risk' and role = 'peer'")
    chunk = scores.best_chunk(F.col("source_text"), F.col("description"), F.col("why"))
    return found.select("citation_id", "company", F.split_part("risk_id", F.lit("_"), F.lit(1)).alias("cik"), F.col("name").alias("risk_theme"), chunk.alias("chunk_text")).withColumn("skip_reason", scores.skip_reason(F.col("chunk_text")))


def target_chunks(rows: DataFrame) -> DataFrame:
    from ..operators import scores

    found = items(rows).where("role = 'target'")
    risk = scores.source_or(F.col("source_text"), F.col("description"), F.col("why"))
    metric = F.when(F.length(F.coalesce("source_text", F.lit(""))) > 0, F.col("source_text")).otherwise(scores.metric_source(F.col("section_title"), F.col("source_page"), F.col("xbrl_tag")))
    w = Window.partitionBy("citation_id").orderBy("ord")
    once = found.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return once.select("citation_id", "type", F.col("name").alias("extracted_name"), F.col("value").alias("extracted_value"), F.col("unit").alias("extracted_unit"), F.when(F.col("type") == "Risk", risk).otherwise(metric).alias("source_text"))
