"""Stored tables of nodes and edges that upserts change bucket by bucket.

A table is a folder: `v<n>/bucket=<b>/` holds files of bucket b as version n wrote them, `_state/<n>` says for every bucket
which version holds it now. A write finds the buckets that its keys fall into, reads those only, merges, writes them as a
new version, and then renames its state into place. Files of other buckets stay as they are, under the same names. Readers
of an older state aren't disturbed; two writers at once can't both put the same state in place, and the later one fails.

What reaches the driver is a number for each bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph
from . import shared

BUCKETS = 64
EDGE_KEYS = ("src_label", "src", "rel", "dst_label", "dst")


class WriteConflict(RuntimeError):
    pass


class StoredTable:
    """schema: of all columns; keys: those that name a row; buckets: how many when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def state(self, version: int | None = None) -> dict:
        """version, buckets and where: the version that holds each bucket."""
        known = [int(n) for n in shared.listed(self.spark, f"{self.path}/_state") if n.isdigit()]
        version = max(known, default=0) if version is None else version
        if not version:
            return {"version": 0, "buckets": self.buckets, "where": {}}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/_state/{version}", wholetext=True).collect()))

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(state["buckets"])).cast("int")

    def _read(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/v{v}/bucket={b}" for b, v in state["where"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.state(version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of these keys; reads their buckets only."""
        state = self.state()
        touched = {r["b"] for r in keys.select(self._bucket(state).alias("b")).distinct().collect()}
        return self._read(state, touched).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def change(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """merge (old rows of the touched buckets, new rows) gives those buckets' rows from now on. Says the version."""
        state = self.state()
        touched = {r["b"] for r in new.select(self._bucket(state).alias("b")).distinct().collect()}
        if not touched:
            return state["version"]
        version = state["version"] + 1
        rows = merge(self._read(state, touched), new).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        at = shared.shared_path(self.spark, "write")
        rows.withColumn("bucket", self._bucket(state)).repartition("bucket").write.partitionBy("bucket").parquet(at)
        if not self._placed(at, f"{self.path}/v{version}"):
            shared.removed(self.spark, at)
            raise WriteConflict(f"version {version} of {self.path} is there already")
        left = {int(n.removeprefix("bucket=")) for n in shared.listed(self.spark, f"{self.path}/v{version}") if n.startswith("bucket=")}
        where = {int(b): v for b, v in state["where"].items() if int(b) not in touched} | dict.fromkeys(left, version)
        mark = shared.shared_path(self.spark, "state")
        content = json.dumps({"version": version, "buckets": state["buckets"], "where": where})
        self.spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(mark)
        if not self._placed(mark, f"{self.path}/_state/{version}"):
            raise WriteConflict(f"state {version} of {self.path} is there already")
        return version

    def _placed(self, old: str, new: str) -> bool:
        shared.made(self.spark, new.rsplit("/", 1)[0])
        return shared.renamed(self.spark, old, new)

    def upsert(self, new: DataFrame, seq: str = "seq", on_create: Sequence[str] = ()) -> int:
        """Nodes: as graph.upsert_nodes, on the touched buckets."""
        return self.change(new, lambda old, rows: graph.upsert_nodes(old, rows, self.keys, seq, on_create))

    def delete(self, gone: DataFrame) -> int:
        return self.change(gone.select(*self.keys), lambda old, rows: old.join(rows.distinct(), self.keys, "left_anti"))

    def cleared(self) -> None:
        shared.removed(self.spark, self.path)

    def vacuum(self) -> int:
        """Deletes versions that the present state doesn't name; says how many bucket folders went. Readers of older states
        must have ended."""
        state, gone = self.state(), 0
        live = {(v, int(b)) for b, v in state["where"].items()}
        for folder in shared.listed(self.spark, self.path):
            if not folder.startswith("v"):
                continue
            version = int(folder[1:])
            for name in shared.listed(self.spark, f"{self.path}/{folder}"):
                if name.startswith("bucket=") and (version, int(name.removeprefix("bucket="))) not in live:
                    shared.removed(self.spark, f"{self.path}/{folder}/{name}")
                    gone += 1
        for n in shared.listed(self.spark, f"{self.path}/_state"):
            if n.isdigit() and int(n) < state["version"]:
                shared.removed(self.spark, f"{self.path}/_state/{n}")
        return gone


class StoredGraph:
    """One table of nodes for each label, one of all nodes' keys, and one of edges, below a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.ends = StoredTable(spark, f"{path}/ends", "label string, key string", ("label", "key"), buckets)
        self.edges = StoredTable(spark, f"{path}/edges", graph.EDGES, EDGE_KEYS, buckets)

    def nodes(self, label: str, schema: str | T.StructType, keys: Sequence[str]) -> StoredTable:
        return StoredTable(self.spark, f"{self.path}/nodes/{label}", schema, keys, self.buckets)

    def add(self, label: str, schema: str | T.StructType, keys: Sequence[str], new: DataFrame, named: Column, **options) -> None:
        """Upserts nodes; named is the key by which edges find them."""
        self.nodes(label, schema, keys).upsert(new, **options)
        ends = new.select(F.lit(label).alias("label"), named.cast("string").alias("key")).where("key is not null").distinct()
        self.ends.change(ends, lambda old, rows: old.unionByName(rows).distinct())

    def connect(self, new: DataFrame, seq: str = "seq") -> int:
        """Upserts edges whose ends are there: only the buckets of these ends and edges are read."""
        both = new.select(F.col("src_label").alias("label"), F.col("src").alias("key")).unionByName(new.select(F.col("dst_label").alias("label"), F.col("dst").alias("key")))
        ends = self.ends.lookup(both)
        return self.edges.change(new, lambda old, rows: graph.upsert_edges(old, rows, ends, seq))
