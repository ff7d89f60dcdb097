"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives v and root, the smallest v of its component, for every v that has an edge.

    Each round links the larger neighbours of every vertex to its smallest one, then the smaller ones; the edges end as
    stars around the roots. Minima are partial aggregates, and a vertex with very many edges is a skewed join key, never
    a list in one task. Every round is written to shared storage.
    """
    step = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = step.unionByName(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written before they are joined: only joins of two exchanges can be split where one vertex is hot.
        least = common.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = common.stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        low = common.stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        new = common.stored(small, "edges")
        # Done when no vertex has two parents and no parent has one: the edges are stars.
        with common.passing(new.sparkSession):
            loose = new.groupBy("a").count().where("count > 1").limit(1).count() or new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        for done in (step, least, large, low):
            common.removed(done)
        step = new
        if not loose:
            break
    return step.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(step.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
