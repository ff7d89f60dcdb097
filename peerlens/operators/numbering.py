"""Running numbers over tables of any size, without a window over a whole group.

A range partitioning deals the rows, in order of group and place, to parts, and a row's position in its part is at hand.
What is then needed of a part is where each group begins in it and how many rows the group has there: a summary with a row
for each group and part that it touches. Sums over a group's earlier parts give where its numbers go on. So a group may fill
any number of parts, and no task sees more than a part.

The dealt rows are written once, so a lost executor or a second reader can't see other bounds of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

_PLACE = (1 << 33) - 1  # the lower bits of monotonically_increasing_id: a row's position in its partition


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """df with the number, from 1, of each row in its group by the order. Rows that are equal in all of the order get
    different numbers; nulls form a group of their own."""
    keys = [f"_g{k}" for k in range(len(group))]
    # Keys of groups as structs, so that null is a value like another.
    rows = df.withColumns({k: F.struct(F.col(g).alias("v")) for k, g in zip(keys, group, strict=True)})
    by = [*[F.col(k) for k in keys], *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place.bitwiseAND(F.lit(_PLACE))}), "numbered")
    counted = dealt.groupBy("_part", *keys).agg(F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("_part", *keys, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from")).alias("_add"))
    out = dealt.join(begins, ["_part", *keys])
    return out.select(*df.columns, (F.col("_place") + F.col("_add") + 1).alias(name))
