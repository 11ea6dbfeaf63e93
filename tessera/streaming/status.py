"""M7: status changes and heartbeats of polled jobs, as a stateful stream over raw polls.

Polls of a job come in any order.  The state keeps them until the watermark
has passed them, takes them in the order of (polled_at, event_id), and says
for each whether the status changed or is the same as before (a heartbeat).
After its first terminal status a job's polls are dropped; a flag stays, so
that what still comes is not taken for a new job.

Calls of state: jobs are dealt by hash over buckets, and the state is keyed
by the bucket.  What a micro-batch brings is handled a bucket at a time with
numpy, so a micro-batch costs some ten calls of the state store a bucket,
however many jobs there are.  The number of buckets belongs to the checkpoint,
like the number of state partitions: a stream goes on with what it began with.

Memory: what a micro-batch brings for a bucket arrives in bounded Arrow
chunks.  A few chunks at a time are sorted and written to the state store
(RocksDB) as a run of small pages; when the event-time timer of the earliest
poll expires, the runs are merged page by page.  A task holds those chunks or
one page of each run, and the last status and count of the bucket's jobs,
never all polls of a job.

Late data: a poll is late if its time is at or before the watermark, the
greatest time seen less the delay; late polls are dropped by Spark before
they reach the state.  Polls of one time go by event_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.runlog import TERMINAL_STATUS
from .metrics import run_available, start_stateful

DELAY = "1 minute"
PAGE = 1024
CHUNKS = 8  # Arrow chunks of a run: merging costs pages times runs, so a bucket with many polls gets fewer, longer ones
BUCKETS = 1024
NULL_BUCKET = -1  # polls without a job_id, which are one job
FIRST_ID = -(1 << 63)  # what a null event_id counts as: the first of its instant
POLLS = "job_id long, polled_at timestamp, event_id long, status string"
EVENTS = "job_id long, k long, polled_at timestamp, status string, prev_status string, event string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: a job that never ends and never has a poll the watermark passes: its polls only move the watermark
CLOCK_JOB = -(1 << 62)


class Run:
    """Cursor over the pages of one sorted run."""

    def __init__(self, processor: "StatusProcessor", run: int, page: int, pages: int):
        self.processor, self.run, self.page, self.pages = processor, run, page, pages
        self.load()

    def load(self) -> None:
        self.polls = None
        if self.page < self.pages:
            (raw,) = self.processor.pages.getValue((self.run, self.page))
            self.polls, self.cut = _unpacked(raw), False

    def key(self, at: int) -> tuple[int, int]:
        return int(self.polls[0][at]), int(self.polls[1][at])

    def take(self, upto: tuple[int, int]) -> list[np.ndarray]:
        """The page's polls up to (time, id); the next page is loaded when none is left."""
        t, ids = self.polls[:2]
        n = int(np.searchsorted(t, upto[0], "right"))
        low = int(np.searchsorted(t, upto[0], "left"))
        n = low + int(np.searchsorted(ids[low:n], upto[1], "right"))
        out = [c[:n] for c in self.polls]
        if n == len(t):
            self.processor.pages.removeKey((self.run, self.page))
            self.page += 1
            self.load()
        elif n:
            self.polls, self.cut = [c[n:] for c in self.polls], True
        return out

    def save(self) -> None:
        """What is left of a page from which some polls were taken is written back."""
        if self.cut:
            self.processor.pages.updateValue((self.run, self.page), (_packed(self.polls),))


def _packed(cols: list[np.ndarray]) -> bytes:
    b = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) if c.dtype == object else pa.array(c) for c in cols], [str(k) for k in range(len(cols))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> list[np.ndarray]:
    with pa.ipc.open_stream(raw) as s:
        return [c.to_numpy(zero_copy_only=False) for c in s.read_next_batch().columns]


class Jobs:
    """Polls counted, last status and end of every job of a bucket, ascending by job."""

    def __init__(self, raw: bytes | None):
        self.job, self.k, self.last, self.done = map(np.array, _unpacked(raw)) if raw else \
            (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, bool))

    def packed(self) -> bytes:
        return _packed([self.job, self.k, self.last, self.done])

    def ended(self, job: np.ndarray) -> np.ndarray:
        if not len(self.job):
            return np.zeros(len(job), bool)
        at = np.minimum(np.searchsorted(self.job, job), len(self.job) - 1)
        return (self.job[at] == job) & self.done[at]

    def _add(self, job: np.ndarray) -> None:
        new = np.setdiff1d(job, self.job)
        at = np.searchsorted(self.job, new)
        self.job, self.k, self.done = np.insert(self.job, at, new), np.insert(self.k, at, 0), np.insert(self.done, at, False)
        self.last = np.insert(self.last, at, np.full(len(new), None, object))

    def events(self, t: np.ndarray, job: np.ndarray, status: np.ndarray) -> pd.DataFrame:
        """Events of polls in order of time, of any jobs; polls after a job's first terminal status yield none."""
        self._add(job)
        at = np.searchsorted(self.job, job)
        x = np.flatnonzero(~self.done[at])
        x = x[np.argsort(at[x], kind="stable")]
        at, t, status = at[x], t[x], status[x]
        first = np.flatnonzero(np.diff(at, prepend=-1))  # where the polls of a job begin
        begin = np.repeat(first, np.diff(first, append=len(at)))
        end = np.array([s in TERMINAL_STATUS for s in status], bool)
        ends = np.cumsum(end) - end  # terminal polls before each
        k = self.k[at] + np.arange(len(at)) - begin + 1
        x = ends == ends[begin]
        at, t, status, end, k = at[x], t[x], status[x], end[x], k[x]
        first = np.diff(at, prepend=-1) > 0
        before = np.empty(len(at), object)
        before[1:] = status[:-1]
        before[first] = self.last[at[first]]
        final = np.append(first[1:], True)[:len(at)]
        self.k[at[final]], self.last[at[final]], self.done[at[final]] = k[final], status[final], end[final]
        change = pd.isna(before) | (~pd.isna(status) & (status != before))
        return pd.DataFrame({"job_id": self.job[at], "k": k, "polled_at": t.astype("datetime64[us]"), "status": status, "prev_status": before,
                             "event": np.where(change, "change", "heartbeat")})


def _open_polls(pdf: pd.DataFrame, jobs: Jobs) -> list[np.ndarray]:
    """Time, id, job and status of the polls whose job has not ended."""
    job, status = pdf["job"].to_numpy(np.int64), pdf["status"].to_numpy(object)
    t = pdf["polled_at"].to_numpy().astype("datetime64[us]").astype(np.int64)
    x = ~jobs.ended(job)
    return [c[x] for c in (t, pdf["event_id"].to_numpy(np.int64), job, np.where(pd.isna(status), None, status))]


class StatusProcessor(StatefulProcessor):
    def __init__(self, heartbeats: bool, page: int = PAGE):
        self.heartbeats, self.size = heartbeats, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "run long, page int", "polls binary")
        self.bucket = handle.getValueState("bucket", "jobs binary, runs binary, next_run long, timer long")  # runs: run, page, pages of each

    def close(self) -> None:
        pass

    def _state(self) -> tuple[Jobs, list, int, int | None]:
        jobs, runs, next_run, timer = self.bucket.get() or (None, b"", 0, None)
        return Jobs(jobs), np.frombuffer(runs, np.int64).reshape(-1, 3).tolist(), next_run, timer

    def _update(self, jobs: Jobs, runs: list, next_run: int, timer: int | None) -> None:
        self.bucket.update((jobs.packed(), np.array(runs, np.int64).tobytes(), next_run, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        jobs, runs, run, timer = self._state()
        rows = iter(rows)
        while chunks := list(islice(rows, CHUNKS)):
            t, ids, job, status = map(np.concatenate, zip(*[_open_polls(pdf, jobs) for pdf in chunks]))
            order = np.lexsort((ids, t))
            if not len(order):
                continue
            polls = [c[order] for c in (t, ids, job, status)]
            many = -(-len(order) // self.size)
            for p in range(many):
                x = slice(p * self.size, (p + 1) * self.size)
                self.pages.updateValue((run, p), (_packed([c[x] for c in polls]),))
            runs.append([run, 0, many])
            run += 1
            timer = self._timer(timer, int(polls[0][0]))
        if runs:
            self._update(jobs, runs, run, timer)
        return iter(())

    def _timer(self, timer: int | None, t: int) -> int:
        """One timer a bucket: just after its earliest poll."""
        at = t // 1000 + 1
        if timer is not None and timer <= at:
            return timer
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, runs, next_run, _ = self._state()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        live = [Run(self, *r) for r in runs]
        while ready := [r for r in live if r.key(0)[0] <= passed]:
            upto = min([r.key(-1) for r in ready] + [(passed, (1 << 63) - 1)])  # what the pages hold of the time up to here is all there is
            t, ids, job, status = map(np.concatenate, zip(*[r.take(upto) for r in ready]))
            live = [r for r in live if r.polls is not None]
            order = np.lexsort((ids, t))
            out = jobs.events(t[order], job[order], status[order])
            if not self.heartbeats:
                out = out[out["event"] == "change"]
            if len(out):
                yield out.assign(job_id=None) if key[0] == NULL_BUCKET else out
        for r in live:
            r.save()
        timer = self._timer(None, min(r.key(0)[0] for r in live)) if live else None
        self._update(jobs, [[r.run, r.page, r.pages] for r in live], next_run, timer)


def status_events(polls: DataFrame, heartbeats: bool = False, delay: str = DELAY, page: int = PAGE, buckets: int = BUCKETS) -> DataFrame:
    """Status events of a stream of polls (job_id, polled_at, event_id, status)."""
    job = F.col("job_id")
    bucket = F.when(job.isNull(), NULL_BUCKET).otherwise(F.pmod(F.xxhash64(job), F.lit(buckets))).cast("int")
    # no nulls among the numbers: pandas would turn them all into floats
    return polls.withWatermark("polled_at", delay) \
        .select(bucket.alias("bucket"), F.coalesce(job, F.lit(0)).cast("long").alias("job"), "polled_at",
                F.coalesce("event_id", F.lit(FIRST_ID)).alias("event_id"), "status") \
        .groupBy("bucket").transformWithStateInPandas(StatusProcessor(heartbeats, page), EVENTS, "Append", "EventTime")


def stream_status_events(spark: SparkSession, src: str, out: str, ckpt: str, heartbeats: bool = False, delay: str = DELAY, page: int = PAGE,
                         buckets: int = BUCKETS) -> None:
    """Read what is new in ``src``, append the events to the Parquet table ``out`` (exactly once)."""
    s = status_events(spark.readStream.schema(POLLS).parquet(src), heartbeats, delay, page, buckets)

    def start():
        return s.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out).outputMode("append") \
            .trigger(availableNow=True).start()
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        run_available(start_stateful(spark, start))
    finally:
        spark.conf.set(key, old)


def clock(spark: SparkSession, polls: DataFrame, ahead: str = "2 minutes") -> DataFrame:
    """One poll of ``CLOCK_JOB`` later than all of ``polls``, which lets the watermark pass these."""
    last = polls.agg(F.max("polled_at").alias("t"))
    return last.where("t is not null").select(F.lit(CLOCK_JOB).alias("job_id"), (F.col("t") + F.expr(f"INTERVAL {ahead}")).alias("polled_at"),
                                              F.lit(0).cast("long").alias("event_id"), F.lit(None).cast("string").alias("status"))
