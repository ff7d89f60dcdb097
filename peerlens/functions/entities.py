"""Raw entities of a model's reply into typed ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numbers, text

METRIC = "metric string, gaap_concept string, value string, unit string, year string, category string, organization string"
RISK = "risk_name string, description string, why string, organization string, source_index int"
INDUSTRY = "industry string, sector string"


def _clean(name: str) -> Column:
    return text.strip(text.as_text(F.col(name)))


def required(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows in which all of these fields have text."""
    out = df
    for n in names:
        out = out.where(F.length(_clean(n)) > 0)
    return out


def metrics(df: DataFrame, company: str) -> DataFrame:
    """name, metric_type, value (text), unit, year, gaap_concept, category, organization, scan_fixed. Rows without a metric
    or a value other than nought are dropped."""
    value = numbers.clean_value(_clean("value"))
    kind, year = _clean("metric"), _clean("year")
    out = df.withColumns({"_v": value, "_m": kind, "_y": year})
    out = out.where((F.col("_m") != "") & F.col("_v").isNotNull())
    extra = [c for c in df.columns if c not in ("metric", "gaap_concept", "value", "unit", "year", "category", "organization")]
    return out.select(
        *extra,
        F.when(F.col("_y") != "", F.concat("_m", F.lit(" ("), "_y", F.lit(")"))).otherwise(F.col("_m")).alias("name"),
        F.col("_m").alias("metric_type"),
        F.col("_v").alias("value"),
        F.coalesce(text.blank_to_null(_clean("unit")), F.lit("ratio")).alias("unit"),
        F.col("_y").alias("year"),
        F.coalesce(text.blank_to_null(_clean("gaap_concept")), F.col("_m")).alias("gaap_concept"),
        _clean("category").alias("category"),
        F.coalesce(text.blank_to_null(_clean("organization")), F.lit(company)).alias("organization"),
        numbers.was_scan_fixed(_clean("value")).alias("scan_fixed"),
    )


def risks(df: DataFrame, company: str) -> DataFrame:
    name = _clean("risk_name")
    extra = [c for c in df.columns if c not in ("risk_name", "description", "why", "organization")]
    return df.where(name != "").select(*extra, name.alias("name"), _clean("description").alias("description"), _clean("why").alias("why"), F.coalesce(text.blank_to_null(_clean("organization")), F.lit(company)).alias("organization"))


def industries(df: DataFrame) -> DataFrame:
    name = _clean("industry")
    extra = [c for c in df.columns if c not in ("industry", "sector")]
    return df.where(name != "").select(*extra, name.alias("industry"), _clean("sector").alias("sector"))


def valid_peer_risks(df: DataFrame, company: str) -> DataFrame:
    """Risks with a name and a description of 20 to 600 characters; a missing organisation is the company."""
    org = _clean("organization")
    return df.where((_clean("risk_name") != "") & F.length(F.coalesce("description", F.lit(""))).between(20, 600)).withColumn("organization", F.when(F.lower(org).isin("", "n/a", "na", "none"), company).otherwise(org))


def source_paragraph(paragraphs: Column, index: Column) -> Column:
    """The paragraph of that number, or all of them."""
    return F.when((index >= 0) & (index < F.size(paragraphs)), F.get(paragraphs, index)).otherwise(F.array_join(paragraphs, "\n\n"))


@dataclass(frozen=True)
class Relation:
    """How one kind of relation is found, parsed and checked."""

    name: str
    schema: str
    required: tuple[str, ...]
    queries: tuple[str, ...]
    parse: Callable[..., DataFrame]
    validate: Callable[..., DataFrame] | None = None
    options: dict = field(default_factory=dict)


_registry: dict[str, Relation] = {}


def register(relation: Relation) -> Relation:
    _registry[relation.name] = relation
    return relation


def relation(name: str) -> Relation:
    if name not in _registry:
        raise KeyError(f"unknown relation {name}; there are {', '.join(relations())}")
    return _registry[name]


def relations() -> list[str]:
    return sorted(_registry)


register(Relation("HAS_METRIC", METRIC, ("metric", "value", "unit", "year", "category"), ("results of operations", "liquidity and capital resources", "quantitative and qualitative disclosures about market risk", "consolidated statements of income"), metrics))
register(Relation("FACES_RISK", RISK, ("risk_name", "description"), ("risk factors",), risks))
register(Relation("OPERATES_IN", INDUSTRY, ("industry", "sector"), ("business",), lambda df, _company: industries(df)))


def flat(pages: DataFrame, replies: DataFrame, kind: Relation) -> DataFrame:
    """The raw entities of all replies, one a row, with where they come from."""
    both = pages.join(replies, ["doc", "source_page"])
    rows = both.select("doc", "section_title", "source_page", F.col("content").alias("chunk_text"), F.posexplode(text.json_array(F.col("reply"), text.struct_of(kind.schema))).alias("pos", "e"))
    return rows.select("doc", "section_title", "source_page", "chunk_text", "pos", "e.*")


def extracted(pages: DataFrame, replies: DataFrame, kind: Relation, company: str) -> DataFrame:
    """pages (doc, section_title, source_page, content) with replies (doc, source_page, reply): typed entities with
    their provenance, numbered over all documents in order of document, page and place (seq)."""
    from ..operators.numbering import numbered

    typed = kind.parse(required(flat(pages, replies, kind), kind.required), company)
    return numbered(typed, [], ["doc", "source_page", "pos"], "seq").withColumn("seq", F.col("seq").cast("int"))
