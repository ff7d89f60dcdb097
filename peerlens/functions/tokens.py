"""Tokens of tags and metric names, for lexical search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_spaces, strip

#: Fixed values.
STOP_WORDS = ("the", "and", "or", "of", "in", "to", "a", "an", "for")
SUFFIXES = ("ings", "ing", "ies", "es", "s")


def tag_tokens(tag: Column) -> Column:
    """Words of a CamelCase tag; a run of capitals is one word."""
    apart = F.regexp_replace(F.regexp_replace(tag, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z])([A-Z])", "$1 $2")
    return F.transform(F.filter(F.split(apart, r"(?U)\s+"), lambda t: F.length(t) >= 2), F.lower)


def stem(token: Column) -> Column:
    """Takes off the first fitting suffix that leaves three letters."""
    out = token
    for suffix in reversed(SUFFIXES):
        n = len(suffix)
        out = F.when(token.endswith(suffix) & (F.length(token) - n >= 3), F.substring(token, F.lit(1), F.length(token) - n)).otherwise(out)
    return out


def name_tokens(name: Column) -> Column:
    return F.transform(F.filter(F.split(name, r"(?U)[\s\-_/]+"), lambda t: F.length(t) >= 2), lambda t: stem(F.lower(t)))


def label_or_tag_tokens(label: Column, tag: Column) -> Column:
    return F.when(F.length(label) > 0, name_tokens(label)).otherwise(tag_tokens(tag))


def query_tokens(name: Column) -> Column:
    """Without stop words, unless nothing is left then."""
    raw = name_tokens(name)
    kept = F.filter(raw, lambda t: ~t.isin(*STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def plain_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")


def concept_keys(concept: Column) -> Column:
    """The forms under which a concept is looked up, in this order: as it is, without brackets, without a plural s."""
    key = collapse_spaces(F.lower(concept))
    bare = strip(F.regexp_replace(key, r"\s*\(.*?\)", ""))
    return F.array(key, bare, F.when(key.endswith("s"), F.substring(key, F.lit(1), F.length(key) - 1)).otherwise(key))


def metric_parts(name: Column) -> tuple[Column, Column]:
    """Type and year of `type (year)`; the year is null without one."""
    year = F.regexp_extract(name, r"\((\d{4})\)\s*$", 1)
    return strip(F.regexp_replace(name, r"\s*\(\d{4}\)\s*$", "")), F.when(F.length(year) > 0, year)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))
