"""Responses of services, fetched through a cache.

A cache is a table of responses (key, status, body, fetched_at), appended to by every fetch and read by its newest row for
each key. What a job needs is joined to it: keys that have a fresh row are hits; keys that have none, or an old one, are
misses, found by an anti-join, each once. Misses are dealt to tasks by key and fetched there at a rate; the new rows are
written, and then everything is read from the table. A service that fails leaves a row without a body, which counts as no
answer and is fetched again the next time; an old answer is used meanwhile.

For a few keys there is a data source, too: `spark.read.format("fetched")` with a pushed condition on key.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from . import shared

SCHEMA = "key string, status int, body string, fetched_at timestamp"
#: Days that labels stay fresh (responses of other kinds don't age), where services are, seconds between calls.
TAXONOMY_DAYS = 30
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK{}.json"
DELAY = 0.2
#: A transport gives the status and the body for a key.
Transport = Callable[[str], tuple[int, str | None]]


def http(url: str = FACTS_URL, agent: str = "research contact@example.org", timeout: int = 30) -> Transport:
    """Fetches url with the key, filled up to ten digits, in its place."""

    def get(key: str) -> tuple[int, str | None]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url.format(key.zfill(10)), headers={"User-Agent": agent}), timeout=timeout) as got:
                return got.status, got.read().decode()
        except HTTPError as failed:
            return failed.code, None

    return get


def recorded(responses: dict[str, str]) -> Transport:
    """What a service said, by key; 404 for other keys."""
    return lambda key: (200, responses[key]) if key in responses else (404, None)


def _fetch(transport: Transport, keys: list[str], free: float, delay: float) -> tuple[list[tuple], float]:
    out = []
    for key in keys:
        time.sleep(max(0.0, free - time.monotonic()))
        free = max(free, time.monotonic()) + delay
        try:
            status, body = transport(key)
        except Exception:  # a service that can't be reached is no reason to lose the others' answers
            status, body = 0, None
        out.append((key, status, body, datetime.now(UTC)))
    return out, free


class Cache:
    """days: how long an answer stays fresh (None: for ever); now: the time by which that is judged, and which new rows get."""

    def __init__(self, spark: SparkSession, path: str, transport: Transport, days: int | None = None, delay: float = DELAY, now: Column | None = None, parts: int | None = None):
        self.spark, self.path, self.transport, self.days, self.delay, self.now, self.parts = spark, path.rstrip("/"), transport, days, delay, now, parts

    def kept(self) -> DataFrame:
        """All fetches that were ever made."""
        there = shared.listed(self.spark, self.path)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def answers(self) -> DataFrame:
        """The newest answer of each key."""
        newest = F.max(F.when(F.col("body").isNotNull(), F.struct("fetched_at", "status", "body")))
        return self.kept().groupBy("key").agg(newest.alias("a")).where("a is not null").select("key", "a.status", "a.body", "a.fetched_at")

    def misses(self, keys: DataFrame) -> DataFrame:
        held = self.answers().select("key", "fetched_at")
        if self.days is not None:
            from .tables import fresh

            held = fresh(held, self.days, "fetched_at", self.now)
        return keys.where("key is not null").select("key").distinct().join(held.select("key"), "key", "left_anti")

    def fetch(self, keys: DataFrame) -> int:
        """Fetches what is missing or old, once; says how many calls that took."""
        transport, delay = self.transport, self.delay

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free = time.monotonic()
            for batch in batches:
                rows, free = _fetch(transport, batch.column("key").to_pylist(), free, delay)
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                kinds = (pa.string(), pa.int32(), pa.string(), pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["key", "status", "body", "fetched_at"])

        # The misses are written before they are asked for: the anti-join must not see what this fetch adds.
        missing = shared.stored(self.misses(keys), "misses")
        before = {f for f in shared.listed(self.spark, self.path)}
        got = missing.repartition(*([self.parts] if self.parts else []), "key").mapInArrow(run, SCHEMA)
        if self.now is not None:
            got = got.withColumn("fetched_at", self.now)
        got.write.mode("append").parquet(self.path)
        new = [f"{self.path}/{f}" for f in shared.listed(self.spark, self.path) if f not in before and f.endswith(".parquet")]
        return self.spark.read.schema(SCHEMA).parquet(*new).count() if new else 0

    def get(self, keys: DataFrame) -> DataFrame:
        """key, status, body, fetched_at of the keys that have an answer, after fetching what is missing."""
        self.fetch(keys)
        return self.answers().join(keys.where("key is not null").select("key").distinct(), "key", "left_semi")


def company_facts(cache: Cache, ciks: DataFrame) -> DataFrame:
    """cik, entityName and facts of companies (cik), through the cache; those without an answer are missing."""
    from .tables import FACTS

    said = cache.get(ciks.select(F.regexp_replace(F.col("cik").cast("string"), "^0+(?=.)", "").alias("key")))
    body = F.from_json("body", FACTS)
    return said.select("key", body.alias("b")).where("b is not null").select(F.col("key").alias("cik"), F.col("b.entityName").alias("entityName"), F.col("b.facts").alias("facts"))


def known_codes(cache: Cache, codes: DataFrame) -> DataFrame:
    """Of industry codes (code) those that the service knows: an answer with an entry."""
    said = cache.get(codes.select(F.col("code").alias("key")))
    return said.where("status = 200 and contains(body, '<entry>')").select(F.col("key").alias("code"))


class Keys(InputPartition):
    def __init__(self, keys: list[str]):
        super().__init__(keys)
        self.keys = keys


class FetchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.keys = options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = found if self.keys is None else self.keys & found
            else:
                yield f

    def partitions(self):
        if self.keys is None:
            raise ValueError("a condition on key has to say what is to be fetched")
        keys, parts = sorted(k for k in self.keys if k is not None), int(self.options.get("parts", 4))
        return [Keys(keys[k::parts]) for k in range(min(parts, len(keys)))] or [Keys([])]

    def read(self, partition):
        module, _, name = self.options["transport"].partition(":")
        transport = getattr(importlib.import_module(module), name)()
        yield from _fetch(transport, partition.keys, time.monotonic(), float(self.options.get("delay", DELAY)))[0]


class Fetched(DataSource):
    """Options: transport (module:function, which gives a transport), parts, delay."""

    @classmethod
    def name(cls):
        return "fetched"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FetchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Fetched)
