"""Replies kept by what was asked: a store that is addressed by the hash of a prompt.

Prompts that have a reply aren't asked again, whichever job, phase or batch they come from, so no two prompts can get each
other's replies. Those that have none are found by an anti-join, each once, and asked on the executors in rounds; every
round is written when it ends. Calls that are throttled go into the next round, which waits longer; other failures are
noted beside their prompts and don't end a run. A task's calls keep to a rate. The service gets the key with the prompt, so
that it can tell a call that a lost executor's task makes again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

SCHEMA = "key string, prompt string, reply string, error string, again boolean, round int"
#: What errors of a service that is too busy say.
BUSY = ("throttl", "too many requests", "overload", "rate exceeded", "service unavailable")
TRIES = 5


def key_of(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def busy(error: Exception) -> bool:
    return isinstance(error, (TimeoutError, ConnectionError)) or any(w in f"{type(error).__name__} {error}".lower() for w in BUSY)


def answered(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """prompts with reply: that of the same prompt in replies (key or prompt, reply); null where there is none."""
    key = F.col("key") if "key" in replies.columns else key_of(F.col("prompt"))
    one = replies.where("reply is not null").groupBy(key.alias("_key")).agg(F.min("reply").alias("reply"))
    return prompts.withColumn("_key", key_of(F.col("prompt"))).join(one, "_key", "left").drop("_key")


class ReplyStore:
    """A provider. call (prompt, key) gives the reply; rate: calls a second in each task at most; wait: seconds before the
    second round, twice as many before each further one; parts: tasks of a round."""

    def __init__(self, spark: SparkSession, path: str, call: Callable[[str, str], str], tries: int = TRIES, wait: float = 1.0, rate: float | None = None, parts: int | None = None):
        self.spark, self.path, self.call, self.tries, self.wait, self.rate, self.parts = spark, path.rstrip("/"), call, tries, wait, rate, parts

    def kept(self) -> DataFrame:
        """All calls that were made, with what came of them."""
        there = shared.listed(self.spark, self.path)
        return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def unanswered(self, prompts: DataFrame) -> DataFrame:
        """key and prompt of those that have no reply yet, each once."""
        keyed = prompts.where("prompt is not null").select(key_of(F.col("prompt")).alias("key"), "prompt").dropDuplicates(["key"])
        return keyed.join(self.kept().where("reply is not null").select("key"), "key", "left_anti")

    def _asked(self, open_: DataFrame, turn: int) -> DataFrame:
        """What the calls give."""
        call, rate = self.call, self.rate
        open_ = open_.repartition(*([self.parts] if self.parts else []), "key")

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            free = time.monotonic()
            for batch in batches:
                replies, errors, again = [], [], []
                for key, prompt in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                    if rate:
                        time.sleep(max(0.0, free - time.monotonic()))
                        free = max(free, time.monotonic()) + 1 / rate
                    try:
                        reply, error, retry = call(prompt, key), None, False
                        if not (reply or "").strip():
                            reply, error, retry = None, "empty reply", True
                    except Exception as failed:
                        reply, error, retry = None, f"{type(failed).__name__}: {failed}", busy(failed)
                    replies.append(reply), errors.append(error), again.append(retry)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("prompt"), pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(again, pa.bool_()), pa.array([turn] * n, pa.int32())],
                    names=["key", "prompt", "reply", "error", "again", "round"],
                )

        return open_.mapInArrow(ask, SCHEMA)

    def fill(self, prompts: DataFrame) -> None:
        """Asks what has no reply, in rounds, until nothing is left that a busy service may still answer."""
        # Written first: what asks must not depend on plans that are run again.
        open_, run = shared.stored(self.unanswered(prompts), "prompts"), uuid.uuid4().hex
        for turn in range(1, self.tries + 1):
            if turn > 1:
                time.sleep(self.wait * 2 ** (turn - 2))
            # A round's rows appear together, when all its calls have ended.
            at = f"{self.path}/run={run}/turn={turn}"
            self._asked(open_, turn).write.parquet(at)
            open_ = self.spark.read.schema(SCHEMA).parquet(at).where("again").select("key", "prompt")
            if open_.isEmpty():
                break

    def replies(self, prompts: DataFrame) -> DataFrame:
        self.fill(prompts)
        return answered(prompts, self.kept())


class Recording:
    """Passes prompts on to another provider and keeps (prompt, reply) below path, for Recorded."""

    def __init__(self, provider, spark: SparkSession, path: str):
        self.provider, self.spark, self.path = provider, spark, path.rstrip("/")

    def replies(self, prompts: DataFrame) -> DataFrame:
        said = shared.stored(self.provider.replies(prompts), "said")
        said.select("prompt", "reply").distinct().write.mode("append").parquet(self.path)
        return said

    def record(self, prompts: DataFrame) -> None:
        """Keeps the replies, of which nothing else is wanted."""
        self.provider.replies(prompts).select("prompt", "reply").distinct().write.mode("append").parquet(self.path)

    def recorded(self) -> DataFrame:
        return self.spark.read.schema("prompt string, reply string").parquet(self.path)
