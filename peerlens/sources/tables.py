"""JSON, CSV and XML inputs, landed responses of services, and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "struct<end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
FACTS = f"cik string, entityName string, facts map<string,map<string,struct<label:string,description:string,units:map<string,array<{ENTRY}>>>>>"
RELATION = "struct<src:struct<type:string,name:string>,tgt:struct<type:string,name:string,properties:map<string,string>>,rel:string,chunk_text:string,section_title:string,source_page:int,sic:struct<code:string,industry:string,sector:string>>"
RELATIONS = f"relations array<{RELATION}>, validated_relation {RELATION}, relation string, company string"
STATE = "job_id string, fiscal_year int, file_path string, main_company string, sic_codes array<string>, extraction_paths array<string>, completed_steps array<int>, created_at string"
HITS = "hits struct<hits:array<struct<_id:string,_source:struct<ciks:array<string>,display_names:array<string>,form:string,adsh:string,file_date:string,period_ending:string>>>>"


#: Sections as a flat list in the order of the document; pages of leaves only.
SECTIONS = "doc string, sections array<struct<pos:int,title:string,level:int,parent:int,leaf:boolean,word_count:bigint,text_length:bigint,pages:array<struct<page_number:int,content:string>>>>"


def sections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SECTIONS).json(path, multiLine=True)


def _section_kind(depth: int) -> str:
    """A section with its subsections, so many levels deep."""
    inner = f",subsections:array<{_section_kind(depth - 1)}>" if depth > 1 else ""
    return f"struct<title:string,level:int,word_count:bigint,text_length:bigint,start_page:int,end_page:int,page_contents:array<struct<page_number:int,content:string>>{inner}>"


#: Headings have six levels, so sections lie in one another at most as deep.
DEPTH = 6


def section_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files with sections in sections, flat: path, pos (in the order of the document), title, level, parent, leaf,
    word_count, text_length, start_page, end_page, pages. Each level is taken apart where the rows are; only the places of a
    document's sections are put in order."""
    files = spark.read.schema(f"sections array<{_section_kind(DEPTH)}>").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "sections")
    level = files.select("path", F.array().cast("array<int>").alias("up"), F.posexplode("sections").alias("k", "s"))
    out = None
    for depth in range(DEPTH, 0, -1):
        level = level.select("path", F.concat("up", F.array("k")).alias("place"), "s")
        inner = F.coalesce(F.size("s.subsections"), F.lit(0)) > 0 if depth > 1 else F.lit(False)
        own = ("title", "level", "word_count", "text_length", "start_page", "end_page")
        one = level.select("path", "place", *[F.col(f"s.{c}").alias(c) for c in own], F.col("s.page_contents").alias("pages"), (~inner).alias("leaf"))
        out = one if out is None else out.unionByName(one)
        if depth > 1:
            level = level.where(inner).select("path", F.col("place").alias("up"), F.posexplode("s.subsections").alias("k", "s"))
    w = Window.partitionBy("path")
    numbered = out.withColumn("pos", F.row_number().over(w.orderBy("place")) - 1)
    places = F.map_from_entries(F.collect_list(F.struct(F.array_join("place", "."), "pos")).over(w))
    above = F.slice("place", 1, F.size("place") - 1)
    parent = F.when(F.size("place") > 1, F.element_at(places, F.array_join(above, ".")))
    return numbered.withColumn("parent", parent).select("path", "pos", "title", "level", "parent", "leaf", "word_count", "text_length", "start_page", "end_page", "pages")


def relations(spark: SparkSession, path: str) -> DataFrame:
    """One row for each relation of all files, in order of path; both layouts of the files are read alike."""
    files = spark.read.schema(RELATIONS).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    every = F.coalesce(F.when(F.col("validated_relation").isNotNull(), F.array("validated_relation")), F.col("relations"), F.array().cast(f"array<{RELATION}>"))
    return files.select("path", F.posexplode(every).alias("pos", "r")).select("path", "pos", "r.*").orderBy("path", "pos")


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).json(path, multiLine=True)


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """seq, id, cik, name, form, adsh, filing_date, period_of_report of landed search pages."""
    from ..functions.text import without_cik_suffix

    pages = spark.read.schema(HITS).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode("hits.hits").alias("pos", "h"))
    return pages.select(
        F.struct("path", "pos").alias("seq"),
        F.col("h._id").alias("id"),
        F.get("h._source.ciks", F.lit(0)).alias("cik"),
        without_cik_suffix(F.get("h._source.display_names", F.lit(0))).alias("name"),
        F.col("h._source.form").alias("form"),
        F.col("h._source.adsh").alias("adsh"),
        F.col("h._source.file_date").alias("filing_date"),
        F.col("h._source.period_ending").alias("period_of_report"),
    )


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """tag, label of a label linkbase: locators, arcs and standard labels joined."""
    raw = spark.read.text(path, wholetext=True)
    attr = lambda c, a: F.regexp_extract(c, rf'{a}="([^"]*)"', 1)
    part = lambda p: raw.select(F.explode(F.regexp_extract_all("value", F.lit(p), F.lit(0))).alias("x"))
    loc = part(r"<(?:\w+:)?loc\b[^>]*>").select(attr("x", "xlink:label").alias("loc"), F.regexp_extract(attr("x", "xlink:href"), r"#(?:[\w-]+?_)?([^_]+)$", 1).alias("tag"))
    arc = part(r"<(?:\w+:)?labelArc\b[^>]*>").select(attr("x", "xlink:from").alias("loc"), attr("x", "xlink:to").alias("lab"))
    label = part(r"(?s)<(?:\w+:)?label\b[^>]*>.*?</(?:\w+:)?label>").where(attr("x", "xlink:role").endswith("/label"))
    label = label.select(attr("x", "xlink:label").alias("lab"), F.regexp_extract("x", r"(?s)>(.*)<", 1).alias("label"))
    return loc.join(arc, "loc").join(label, "lab").select("tag", "label").distinct()


def fresh(cached: DataFrame, days: int = 30, at: str = "cached_at", now: Column | None = None) -> DataFrame:
    """Rows of a cache that are not older than so many days."""
    return cached.where(F.col(at) >= (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(days)))


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=10_000_000)


def job_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).json(path, multiLine=True)


def evaluation_inputs(spark: SparkSession, path: str) -> DataFrame:
    """question, answer and results (JSON) of a question's artefacts below path, as write_answer leaves them."""
    extraction = spark.read.schema("question string, record_count long, results string").json(f"{path}/extraction_result")
    answer = spark.read.text(f"{path}/answer", wholetext=True).select(F.trim(F.regexp_replace("value", r"\s+$", "")).alias("answer"))
    return extraction.join(answer)


def write_answer(path: str, extraction: DataFrame, answer: DataFrame, reasoning: DataFrame) -> None:
    """The artefacts of one question, a row each: question, record_count and results; the answer; the reasoning."""
    extraction.write.mode("overwrite").json(f"{path}/extraction_result")
    answer.write.mode("overwrite").text(f"{path}/answer")
    reasoning.write.mode("overwrite").text(f"{path}/reasoning")


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(detail: DataFrame, summary: DataFrame, path: str) -> None:
    from ..operators.scores import with_summary

    with_summary(detail, summary).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
