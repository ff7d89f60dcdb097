"""Batches of consecutive items, over tables of any size.

A rule says, from how much a batch holds and the next item's size, whether the item opens a batch, closes one, and what is
held then. That is sequential by nature, but there are few values that can be held. So each part of the ordered rows is
folded for every value that may come in, which gives a short summary: what goes out, and how many batches were closed. The
summaries, one for each part, are put together in order; then each part is folded once more, from what really comes in.

No task sees more than a part, and a part's summary is a few runs of values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: (held, size) to: whether a batch ends before the item, whether one ends behind it, what is held then. held is an array.
Rule = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_size(least: int = 5000) -> tuple[Rule, int]:
    """A batch ends when it holds `least`; an item that large is a batch alone. With the number of values that can be held."""

    def rule(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if size >= least:
            return held > 0, np.ones(len(held), bool), np.zeros_like(held)
        full = held + size >= least
        return np.zeros(len(held), bool), full, np.where(full, 0, held + size)

    return rule, least


def by_call(most: int = 10) -> tuple[Rule, int]:
    """A batch takes items while it holds `most` or less with them."""

    def rule(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = (held > 0) & (held + size > most)
        return full, np.zeros(len(held), bool), np.minimum(np.where(full, size, held + size), most + 1)

    return rule, most + 2


def fold(sizes: Sequence[int], rule: Rule, held: int = 0, batch: int = 0) -> tuple[list[int], int, int]:
    """The batch of each item, what is held in the end, and the number of the batch that is open then."""
    out: list[int] = []
    steps: dict[tuple[int, int], tuple[int, int, int]] = {}  # what the rule has said
    for size in sizes:
        step = steps.get((held, size))
        if step is None:
            step = steps[held, size] = tuple(int(x[0]) for x in rule(np.array([held], np.int64), size))
        batch += step[0]
        out.append(batch)
        batch += step[1]
        held = step[2]
    return out, held, batch


def summary(sizes: Sequence[int], rule: Rule, states: int) -> list[tuple[int, int, int]]:
    """Runs of incoming values: first value, batches that end, what is held in the end."""
    held, which, ended = np.arange(states, dtype=np.int64), np.arange(states), np.zeros(states, np.int64)
    for k, size in enumerate(sizes):
        before, after, held = rule(held, size)
        ended = ended + before + after
        pairs, back = np.unique(np.stack([held, ended]), axis=1, return_inverse=True)  # alike now, alike from here on
        held, ended, which = pairs[0], pairs[1], back.reshape(-1)[which]
        if len(held) == 1:
            _, last, more = fold(sizes[k + 1 :], rule, int(held[0]))
            held, ended = np.array([last]), ended + more
            break
    end, count = held[which], ended[which]
    first = np.flatnonzero(np.r_[True, (np.diff(end) != 0) | (np.diff(count) != 0)])
    return [(int(s), int(count[s]), int(end[s])) for s in first]


def _through(runs: list[tuple[int, int, int]], held: int, batch: int) -> tuple[int, int]:
    """What goes out of a part, and the batch that is open then."""
    run = next(r for r in reversed(runs) if r[0] <= held)
    return run[2], batch + run[1]


def batched(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], size: str, kind: tuple[Rule, int], name: str = "batch") -> DataFrame:
    """df with the number, from 0, of each row's batch in its group. size: a column of whole numbers; null counts as 0."""
    rule, states = kind
    # A group is named by its values as JSON, in which null is a value like another.
    rows = df.withColumns({"_group": F.to_json(F.struct(*[F.col(g).alias(f"g{k}") for k, g in enumerate(group)]), {"ignoreNullFields": "false"}) if group else F.lit(""), "_size": F.coalesce(F.col(size).cast("long"), F.lit(0))})
    by = ["_group", *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}), "batched")
    lean = dealt.select("_part", "_place", "_group", "_size")

    def cut(table: pa.Table) -> tuple[list[int], list[str], np.ndarray, list[int]]:
        """The places, groups and sizes of a part in order, and where its groups begin."""
        table = table.sort_by("_place")
        groups = table["_group"].to_pylist()
        begins = [k for k in range(len(groups)) if not k or groups[k] != groups[k - 1]]
        return table["_place"].to_pylist(), groups, table["_size"].to_numpy(), begins

    def sum_up(table: pa.Table) -> pa.Table:
        _, groups, sizes, begins = cut(table)
        runs = summary(sizes[: begins[1] if len(begins) > 1 else None].tolist(), rule, states)
        _, held, open_ = fold(sizes[begins[-1] :].tolist(), rule)
        row = {"_part": table["_part"][0].as_py(), "first": groups[0], "last": groups[-1], "single": len(begins) == 1, "runs": [x for r in runs for x in r], "held": held, "open": open_}
        return pa.Table.from_pylist([row], schema=pa.schema([("_part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("runs", pa.list_(pa.int64())), ("held", pa.int64()), ("open", pa.int64())]))

    parts = lean.groupBy("_part").applyInArrow(sum_up, "_part int, first string, last string, single boolean, runs array<long>, held long, open long").collect()
    comes: dict[int, tuple[int, int]] = {}
    last, held, batch = None, 0, 0
    for p in sorted(parts, key=lambda p: p["_part"]):
        comes[p["_part"]] = (held, batch) if p["first"] == last else (0, 0)
        if p["single"]:
            runs = [tuple(p["runs"][k : k + 3]) for k in range(0, len(p["runs"]), 3)]
            held, batch = _through(runs, *comes[p["_part"]])
        else:
            held, batch = p["held"], p["open"]
        last = p["last"]

    def number(table: pa.Table) -> pa.Table:
        places, _, sizes, begins = cut(table)
        part = table["_part"][0].as_py()
        out: list[int] = []
        for k, (b, e) in enumerate(zip(begins, [*begins[1:], len(places)], strict=True)):
            out += fold(sizes[b:e].tolist(), rule, *(comes[part] if not k else (0, 0)))[0]
        return pa.Table.from_arrays([pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(out, pa.int64())], names=["_part", "_place", "_batch"])

    numbers = lean.groupBy("_part").applyInArrow(number, "_part int, _place long, _batch long")
    return dealt.join(numbers, ["_part", "_place"]).select(*df.columns, F.col("_batch").alias(name))
