"""Text as column expressions. White space means Unicode white space, as filings are full of no-break spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def without_thinking(c: Column) -> Column:
    """Drops what a model writes between think tags."""
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def inside_thinking(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1))


def reasoning_trace(c: Column, least: int = 100) -> Column:
    """What stands outside the think tags, or inside them if that is shorter than `least` characters."""
    outside = without_thinking(c)
    return F.when(F.length(outside) < least, inside_thinking(c)).otherwise(outside)


def json_block(c: Column) -> Column:
    """From the first [ to the last ]; null if there is none."""
    return blank_to_null(F.regexp_extract(c, r"(?s)\[.*\]", 0))


def without_fences(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"```(?:json)?", ""))


def fenced(c: Column, language: str = "cypher") -> Column:
    """The body of a fenced block, or the whole if there is none."""
    body = F.regexp_extract(c, rf"(?is)```(?:{language})?\s*(.*?)```", 1)
    return strip(F.when(F.length(body) > 0, body).otherwise(c))


def struct_of(columns: str) -> str:
    """A struct type from a list of columns and their types."""
    return "struct<" + ",".join(":".join(part.split()) for part in columns.split(",")) + ">"


def json_array(c: Column, schema: str) -> Column:
    """Rows of a tolerant JSON array; an empty array where the text holds none."""
    return F.coalesce(F.from_json(json_block(c), f"array<{schema}>"), F.from_json(F.lit("[]"), f"array<{schema}>"))


def as_text(c: Column) -> Column:
    """Null and nested JSON values count as empty, like every value that is no scalar."""
    return F.when(c.isNull() | c.rlike(r"^\s*[\[{]"), "").otherwise(c)


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), SPACE, " ")


def truncated(c: Column, most: int = 400) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def without_cik_suffix(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s*\(CIK\s+\d+\)\s*$", ""))


def paragraphs(c: Column, above: int = 30) -> Column:
    """Parts between blank lines that have more than `above` words."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: word_count(p) > above)


def numbered_lines(c: Column, most: int) -> Column:
    """Texts of the lines `1. text`, at most `most` of them."""
    found = F.filter(F.split(c, "\n"), lambda x: strip(x).rlike(r"^\d+\.\s+.+"))
    return F.slice(F.transform(found, lambda x: strip(F.regexp_extract(strip(x), r"^\d+\.\s+(.+)", 1))), 1, most)


def masked(c: Column, name: Column, by: str = "the company") -> Column:
    """Replaces a name, whatever its case."""
    return F.when(F.length(name) > 0, F.regexp_replace(c, F.concat(F.lit(r"(?i)\Q"), name, F.lit(r"\E")), F.lit(by))).otherwise(c)


def chunk_id(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 8)


def is_true(c: Column) -> Column:
    return F.lower(strip(c)) == "true"


def without_citations(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?i)\[CITE:[^\]]+\]", ""))


def citations(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\[CITE:([^\]]+)\]"), F.lit(1)), strip)


def longest_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The longest of all matches, the first of equally long ones; empty if there is none."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    ranked = F.transform(found, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("first"), x.alias("x")))
    return F.coalesce(F.array_max(ranked)["x"], F.lit(""))


#: Where the risk section starts and ends, and what stands for none.
ITEM_1A = r"(?is)item\s+1a[\.\s]*risk\s+factors(.*?)(?:item\s+1b|item\s+2)"
NO_RISKS = "Risk factors section not found."


def item_1a(c: Column) -> Column:
    """The longest risk section; a table of contents has a shorter one."""
    return F.when(c.rlike(ITEM_1A), strip(longest_match(c, ITEM_1A))).otherwise(NO_RISKS)


def contains_any(columns: list[Column], topics: list[str]) -> Column:
    """Whether any column holds any topic, in lower case; no topics: true."""
    if not topics:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        for topic in topics:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(topic.lower())), F.lit(False))
    return hit


def metric_summary(label: Column, value: Column, unit: Column, year: Column) -> Column:
    """`label = value unit (year)`."""
    return F.concat(F.coalesce(label, F.lit("")), F.lit(" = "), F.coalesce(value, F.lit("")), F.lit(" "), F.coalesce(unit, F.lit("")), F.lit(" ("), F.coalesce(year, F.lit("")), F.lit(")"))


def risk_summary(name: Column, description: Column) -> Column:
    return F.concat_ws(" — ", name, description)


def numbered(items: Column) -> Column:
    """An array as `[0]` and text, one after the other, as prompts list paragraphs."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("]\n"), x)), "\n\n")
