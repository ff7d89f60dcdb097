"""Jobs followed event by event: keyed state with timers.

For every job the state holds the latest status of each step (not the events), when the job was last heard of, and when it
ended. What comes out is a log that clients can read on from any point:

* `step`: an event that is newer than what was known of its step; repeated and outdated events give none.
* `heartbeat`: nothing was heard of an open job for `silence`.
* `end`: the terminal event of a job. Later events of the job give none.
* `expired`: nothing was heard of an open job for `idle`; its state is dropped.

Of an ended job only the fact that it ended stays, for `idle`; then its state is dropped, too. So the state grows with the
jobs that are open or ended lately. Time is that of the events, behind a watermark, or the clock's.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .steps import TERMINAL

LOG = "job_id string, kind string, step int, status string, ts timestamp"
#: Fixed value: a client hears something at least so often.
SILENCE_SECONDS = 30
IDLE_SECONDS = 24 * 3600
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Entry = Row("job_id", "kind", "step", "status", "ts")
_EPOCH = datetime(1970, 1, 1)


def _micros(ts: datetime) -> int:
    d = ts.astimezone(UTC).replace(tzinfo=None) - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _time(micros: int) -> datetime:
    return datetime.fromtimestamp(micros // 1_000_000, UTC).replace(microsecond=micros % 1_000_000)


class Follower(StatefulProcessor):
    def __init__(self, silence: int = SILENCE_SECONDS, idle: int = IDLE_SECONDS, clock: bool = False):
        self.silence, self.idle, self.clock = silence * 1000, idle * 1000, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step int", "at bigint, status string")
        #: When the job was last heard of, and when it ended (0: it is open), in microseconds; when its timer goes off.
        self.job = handle.getValueState("job", "heard bigint, ended bigint, timer bigint")

    def _wake(self, was: int, at: int) -> int:
        """Replaces the timer."""
        if was != at:
            if was:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (job,) = key
        heard, ended, timer = self.job.get() if self.job.exists() else (0, 0, 0)
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else 0
        # Steps are read from the state and written to it once in a trigger, not for each event.
        known: dict[int, tuple | None] = {}
        changed: set[int] = set()
        # Rows come in any order; those of one trigger and job are put in theirs, the terminal one last of equal times.
        for r in sorted(rows, key=lambda r: (r["ts"], r["status"] in TERMINAL, r["step"] or 0, r["status"] or "")):
            at = _micros(r["ts"])
            if ended:
                continue
            heard = max(heard, at)
            if r["status"] in TERMINAL:
                ended = at
                self.steps.clear()
                changed.clear()
                yield Entry(job, "end", None, r["status"], r["ts"])
                continue
            step = r["step"] or 0
            if step not in known:
                known[step] = self.steps.getValue((step,)) if self.steps.containsKey((step,)) else None
            last = known[step]
            if last is None or (at, r["status"] or "") > (last[0], last[1] or ""):
                known[step] = (at, r["status"])
                changed.add(step)
                yield Entry(job, "step", r["step"], r["status"], r["ts"])
        for step in sorted(changed):
            self.steps.updateValue((step,), known[step])
        since = now or (ended or heard) // 1000
        self.job.update((heard, ended, self._wake(timer, since + (self.idle if ended else self.silence))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (job,) = key
        if not self.job.exists():
            return
        heard, ended, timer = self.job.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at != timer:
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else max(at, timerValues.getCurrentWatermarkInMs())
        if ended or now >= heard // 1000 + self.idle:
            if not ended:
                yield Entry(job, "expired", None, None, _time(now * 1000))
            self.steps.clear()
            self.job.clear()
            return
        yield Entry(job, "heartbeat", None, None, _time(now * 1000))
        self.handle.registerTimer(now + self.silence)
        self.job.update((heard, ended, now + self.silence))

    def close(self) -> None:
        pass


def followed(stream: DataFrame, late: str = "10 minutes", clock: bool = False, **limits: int) -> DataFrame:
    """The log of a stream of events (job_id, step, status, ts). Events older than the watermark are left out, as are those
    without a job or a time."""
    lean = stream.select("job_id", F.col("step").cast("int").alias("step"), "status", "ts").where("job_id is not null and ts is not null")
    lean = lean if clock else lean.withWatermark("ts", late)
    return lean.groupBy("job_id").transformWithState(Follower(clock=clock, **limits), LOG, "append", "processingTime" if clock else "eventTime")


def start(log: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Appends the log to files below path, each row exactly once, also over restarts. once: until all that is there has been
    read; else a trigger every so often."""
    spark: SparkSession = log.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # a query takes the setting when it starts
    try:
        writer = log.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).format("parquet").start(path)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def latest(log: DataFrame) -> DataFrame:
    """Of each job and step the last status, how many changes there were, and how the job ended (null while it is open)."""
    ends = log.where("kind = 'end'").groupBy("job_id").agg(F.min("status").alias("ended"))
    steps = log.where("kind = 'step'").groupBy("job_id", "step").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.count(F.lit(1)).alias("n"))
    return steps.join(ends, "job_id", "left")
