"""Markdown into a flat table of sections with parents and pages.

A document is one row; its lines are folded inside arrays and window frames within a document, so documents of any number
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

HEADING = r"^(#{1,6})\s+(.+)"
BREAK = "<<<PAGE_BREAK>>>"
LEVELS = 6


def headed(docs: DataFrame, doc: str = "doc", body: str = "text") -> DataFrame:
    """doc, pos, title, level, raw of every section. A text without headings is one section named Document; what stands
    before the first heading belongs to none."""
    lines = F.split(F.coalesce(F.col(body), F.lit("")), "\n")
    cut = docs.select(F.col(doc).alias("doc"), lines.alias("lines"))
    heads = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull())
    found = cut.withColumn("heads", heads)
    none = F.size("heads") == 0

    def section(at: Column, pos: Column) -> Column:
        title = F.get(F.col("lines"), at)
        end = F.coalesce(F.get(F.col("heads"), pos + 1), F.size("lines"))
        return F.struct(
            pos.alias("pos"),
            text.strip(F.regexp_extract(title, HEADING, 2)).alias("title"),
            F.length(F.regexp_extract(title, HEADING, 1)).alias("level"),
            text.strip(F.array_join(F.slice("lines", at + 2, end - at - 1), "\n")).alias("raw"),
        )

    whole = F.array(F.struct(F.lit(0).alias("pos"), F.lit("Document").alias("title"), F.lit(1).alias("level"), text.strip(F.array_join("lines", "\n")).alias("raw")))
    # All of it happens in the document's row, so nothing is shuffled.
    return found.select("doc", F.inline(F.when(none, whole).otherwise(F.transform("heads", section))))


def with_parents(sections: DataFrame) -> DataFrame:
    """parent: the nearest section before with a lower level, null at the top; above: all that it lies in, the parent
    first; leaf: whether it has no subsection."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.lit(k) < F.col("level"), F.max(F.when(F.col("level") == k, F.col("pos"))).over(w)) for k in range(1, LEVELS)]
    # The last section of a level is above this one unless one of a lower level came after it.
    held = [x if not k else F.when(F.coalesce(F.greatest(F.lit(-1), *last[:k]) < x, F.lit(False)), x) for k, x in enumerate(last)]
    after = F.lead("level").over(Window.partitionBy("doc").orderBy("pos"))
    out = sections.withColumns({"parent": F.greatest(*last), "above": F.sort_array(F.filter(F.array(*held), lambda p: p.isNotNull()), asc=False)})
    return out.withColumn("leaf", F.coalesce(after <= F.col("level"), F.lit(True)))


def with_pages(sections: DataFrame) -> DataFrame:
    """pages of leaves (page_number, content). The number goes on with every part between breaks; a part that is only a
    number counts as a page but isn't kept; a leaf without any part keeps its raw text."""
    parts = F.transform(F.split("raw", BREAK), text.strip)
    counted = sections.withColumn("parts", F.when(F.col("leaf"), parts))
    n = F.when(F.col("leaf"), F.size("parts")).otherwise(0)
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    started = counted.withColumn("first_page", (F.coalesce(F.sum(n).over(w), F.lit(0)) + 1).cast("int"))
    numbered = F.transform("parts", lambda x, i: F.struct((F.col("first_page") + i).alias("page_number"), x.alias("content")))
    kept = F.filter(numbered, lambda p: (p["content"] != "") & ~p["content"].rlike(r"(?U)^\s*\d+\s*$"))
    none = F.array(F.struct((F.col("first_page") + F.size("parts")).alias("page_number"), F.col("raw").alias("content")))
    pages = started.withColumn("pages", F.when(F.col("leaf"), F.when(F.size(kept) > 0, kept).otherwise(none)))
    total = lambda f: F.when(F.col("leaf"), F.aggregate("pages", F.lit(0), lambda a, p: a + f(p["content"])))
    return pages.select(
        *[c for c in sections.columns if c != "raw"],
        "pages",
        F.get("pages", F.lit(0))["page_number"].alias("start_page"),
        F.element_at("pages", -1)["page_number"].alias("end_page"),
        total(F.length).alias("text_length"),
        total(text.word_count).alias("word_count"),
    )


def rolled_up(sections: DataFrame) -> DataFrame:
    """word_count and text_length of inner sections: the sums over the leaves below them."""
    leaves = sections.where("leaf").select("doc", F.explode("above").alias("pos"), "word_count", "text_length")
    sums = leaves.groupBy("doc", "pos").agg(F.sum("word_count").alias("_words"), F.sum("text_length").alias("_chars"))
    joined = sections.join(sums, ["doc", "pos"], "left")
    return joined.withColumns({"word_count": F.coalesce("word_count", "_words", F.lit(0)).cast("long"), "text_length": F.coalesce("text_length", "_chars", F.lit(0)).cast("long")}).drop("_words", "_chars")


def parse(docs: DataFrame, doc: str = "doc", body: str = "text") -> DataFrame:
    return rolled_up(with_pages(with_parents(headed(docs, doc, body))))


def first_pages(sections: DataFrame, n: int = 4) -> DataFrame:
    """The text of the first n pages of each document."""
    pages = sections.where("leaf").select("doc", "pos", F.posexplode("pages").alias("i", "page"))
    w = Window.partitionBy("doc").orderBy("pos", "i")
    top = pages.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("page.content").alias("c")))), lambda x: x["c"]), "\n\n")
    return top.groupBy("doc").agg(joined.alias("text"), F.count("*").alias("n"))


def company_name(reply: Column) -> Column:
    """What a reply names, without quotes; fails for names of three characters or fewer."""
    name = text.strip(F.regexp_replace(text.strip(reply), r"^[\"']+|[\"']+$", ""))
    return F.when(F.length(name) > 3, name).otherwise(F.raise_error(F.concat(F.lit("no company name: "), name)))


def guarded_company(name: Column) -> Column:
    """Fails for an empty name and for placeholders."""
    clean = text.strip(F.coalesce(name, F.lit("")))
    return F.when(~F.lower(clean).isin("", "the company", "this company"), clean).otherwise(F.raise_error(F.lit("company name not set")))
