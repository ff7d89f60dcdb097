"""Distinct rows by first or last occurrence, nested lists included. Every order comes from explicit columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key. They are the first in each task, too, so a key that very many rows have is cut down to n
    rows of each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: last write wins."""
    return first_of(df, keys, [F.col(c).desc() for c in order])


def relations(df: DataFrame) -> DataFrame:
    """Relations by source, kind and target name."""
    return first_of(df, ["src", "rel", "tgt"], ["seq"])


def metrics(df: DataFrame) -> DataFrame:
    return first_of(df, [F.lower(F.trim("name")), "year"], ["seq"])


def risks(df: DataFrame) -> DataFrame:
    return first_of(df, [F.lower(F.trim("name"))], ["seq"])


def rows(df: DataFrame, but: Sequence[str] = ("_strategy",), order: str = "seq") -> DataFrame:
    """Rows that differ in any column but these and the order."""
    keys = [c for c in df.columns if c not in {*but, order}]
    return first_of(df, keys, [order])


def nested(df: DataFrame, fields: Sequence[str], keys: Sequence[str], order: str, peer: str = "peer") -> DataFrame:
    """Drops items of list columns that an earlier row has already; fields that start with "peer" are compared within
    their peer only. An item's key is its first field of keys that isn't null; items without one stay."""
    kind = "array<struct<field:string,space:string,key:string,pos:int>>"
    lists = []
    for field in fields:
        names = [f.name for f in df.schema[field].dataType.elementType.fields]
        lists.append(F.coalesce(_item_keys(field, [k for k in keys if k in names], peer), F.array().cast(kind)))
    if not lists:
        return df
    # The keys of all lists are exploded and ranked once; the items themselves stay in their row.
    items = df.select(order, F.inline(F.concat(*lists))).where("key <> ''")
    place = F.struct(order, "pos")
    first = items.groupBy("field", "space", "key").agg(F.min(place).alias("first"))
    again = items.join(first, ["field", "space", "key"]).where(place > F.col("first"))
    out = df.join(again.groupBy(order).agg(F.collect_set(F.struct("field", "pos")).alias("_gone")), order, "left")
    return out.withColumns({field: _not_gone(field) for field in fields}).select(*df.columns)


def _item_keys(field: str, keys: Sequence[str], peer: str) -> Column:
    space = F.coalesce(F.col(peer).cast("string"), F.lit("")) if field.startswith("peer") else F.lit("")
    return F.transform(
        field,
        lambda x, i: F.struct(F.lit(field).alias("field"), space.alias("space"), F.coalesce(*[x[k].cast("string") for k in keys], F.lit("")).alias("key"), i.alias("pos")),
    )


def _not_gone(field: str) -> Column:
    return F.filter(field, lambda _, i: ~F.coalesce(F.array_contains("_gone", F.struct(F.lit(field).alias("field"), i.alias("pos"))), F.lit(False)))


def best_by(df: DataFrame, keys: Sequence[Column | str], score: Column, tie: str) -> DataFrame:
    """The row of the highest score; ties go to the earlier one."""
    return first_of(df, keys, [score.desc(), F.col(tie)])
