"""The steps of a job as a stream of events (job_id, step, name, label, status, message, ts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "job_id string, step int, name string, label string, status string, message string, summary string, error string, ts timestamp"
#: The steps, and the events after which nothing follows.
STEPS = ("parse", "extract", "target graph", "peers", "peer graph")
TERMINAL = ("pipeline_complete", "pipeline_failed")


def events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def folded(rows: DataFrame) -> DataFrame:
    """job_id, step, status (the latest), started, ended and seconds. Works on a table and, in complete mode, on a stream."""
    done = F.col("status").isin("done", "failed")
    return (
        rows.groupBy("job_id", "step")
        .agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started"), F.max(F.when(done, F.col("ts"))).alias("ended"))
        .withColumn("seconds", F.unix_micros("ended") / 1e6 - F.unix_micros("started") / 1e6)
    )


def follow(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs the fold over what has arrived; sink gets the whole state after each trigger."""
    return folded(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


def recent(rows: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of each status in windows of time; later ones than the watermark are left out."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "status").count()


def next_step(completed: DataFrame, steps: int = len(STEPS)) -> DataFrame:
    """For each job (job_id, completed_steps) the first step that isn't completed; null if all are."""
    every = completed.select("job_id", F.explode(F.array_except(F.sequence(F.lit(1), F.lit(steps)), F.col("completed_steps"))).alias("step"))
    return completed.select("job_id").join(every.groupBy("job_id").agg(F.min("step").alias("step")), "job_id", "left")
