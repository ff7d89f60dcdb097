"""Collapses cumulative snapshots of chats and renders those that stay.

Loggers often store a conversation after every turn, so that each log is a prefix of the next. A rolling hash over the
turns names every prefix of every conversation: running sums, in a window over the conversation's turns, of two hashes of
each turn with its place. A conversation whose full name is a proper prefix of another is dropped by an anti-join, and of
equal conversations the one with the smallest id stays. Turns stay rows (which the window may spill) until the
conversations that are left are put together.

Defined cases: turns are ordered by turn (null first), then role, then text; null roles and texts count as empty, and
repeated rows, or others with the same turn, as further turns. Rows with a null conv_id are one conversation. A very long
text is hashed whole; a conversation that stays is one row. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Marks around a role and after a text.
TEMPLATE = ("<|", "|>\n", "\n")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (a turn's place, from 1), total, role, text, and a and b: the name of the prefix that ends with it."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumns({"n": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy("conv_id"))})
    # As decimals, since 64-bit sums would overflow.
    hashed = numbered.withColumns({"a": F.xxhash64("n", "role", "text").cast("decimal(20,0)"), "b": F.xxhash64("text", F.lit(23), "role", "n").cast("decimal(20,0)")})
    return hashed.select("conv_id", "n", "total", "role", "text", F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and turns (array of role, text) of the conversations that stay."""
    # Three readers below; the written form also survives the loss of an executor.
    rows = common.stored(prefixes(turns), "turns")
    proper = rows.where("n < total").select("a", "b", "n").distinct()
    # Equal conversations fold in a partial aggregation before anything is shuffled by name. The struct keeps a null id.
    full = rows.where("n = total").groupBy("a", "b", "n").agg(F.min(F.struct("conv_id")).alias("one"))
    stay = full.join(proper, ["a", "b", "n"], "left_anti").select(F.col("one.conv_id").alias("id"))
    left = rows.join(stay, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")
    each = left.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    return each.select("conv_id", F.size("turns").alias("n_turns"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(convs: DataFrame) -> DataFrame:
    """Adds rendered: every turn as its role between marks, then its text."""
    left, right, end = TEMPLATE
    return convs.withColumn("rendered", F.array_join(F.transform("turns", lambda t: F.concat(F.lit(left), t["role"], F.lit(right), t["text"], F.lit(end))), ""))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = render(collapse(common.table(spark, sf_dir, "conversations")))
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "rendered")


OP7_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '')
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '') ROWS UNBOUNDED PRECEDING) AS rendered
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
), f AS (SELECT min(conv_id) AS conv_id, n, rendered FROM t WHERE n = total GROUP BY n, rendered)
SELECT conv_id, n AS n_turns, rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.n < t.total AND t.n = f.n AND t.rendered = f.rendered)
"""
