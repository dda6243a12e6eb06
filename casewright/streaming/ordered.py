"""Task events of a stream in the order of their times, whatever the order and the batches in which they come.

A task's events are held in state until the watermark has passed them and then stepped through by time and id, so
results don't hang on how the stream was cut; an event that comes behind the watermark is told apart as late. Tasks
share states in buckets, since each call to a state costs far more than what it carries. Times are whole microseconds.
On top of that: changes of a task's progress, and the deadlines of tasks (polls that give up, results that expire), which
fire by timers also where no event comes any more.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from casewright.operators.status import clamp
from casewright.streaming.progress import LATENESS, timed

TERMINAL = ("SUCCESS", "FAILURE")
#: Tasks share states by a hash of their ids; a checkpoint holds for one number of buckets.
BUCKETS = 512
#: Stands for an event's missing id where rows are numbers without nulls.
_NONE = -(1 << 63)


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started within keep their state in RocksDB, which lists, timers and time-outs of state need."""
    key, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, kind)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _packed(rows) -> bytes:
    import pyarrow as pa

    with pa.ipc.new_stream(sink := pa.BufferOutputStream(), rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all()


class InOrder(StatefulProcessor):
    """Holds the events of a bucket's tasks until the watermark passes them; subclasses say what a step does with a task's `known` values.

    A state is one Arrow table for the whole bucket, so that it is asked for once, not for each task and event. While a
    bucket's events are stepped through, those of the watermark's delay and of one batch are in memory.
    """

    KNOWN: list[str]
    OUT: str

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "events binary")
        self.known = handle.getValueState("known", "tasks binary")

    def handleInputRows(self, key, rows, timerValues):
        import pyarrow as pa

        passed, least = timerValues.getCurrentWatermarkInMs() * 1000, None
        schema = pa.schema([("task", pa.string()), ("at", pa.int64()), ("event_id", pa.int64()), ("value", pa.int64())])
        for frame in rows:
            late = frame["at"] <= passed
            if late.any():
                yield self._frame([(r.task, *self.late(r)) for r in frame[late].itertuples()])
            fresh = frame[~late]
            if len(fresh):
                self.held.appendValue((_packed(pa.Table.from_pandas(fresh[schema.names], schema, preserve_index=False)),))
                at = int(fresh["at"].min())
                least = at if least is None else min(least, at)
        if least is not None:
            self._wake(least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pyarrow as pa
        import pyarrow.compute as pc

        passed, found = timerValues.getCurrentWatermarkInMs() * 1000, []
        parts = [_unpacked(x[0]) for x in self.held.get()]
        later = None
        before = dict((task, tuple(x)) for task, *x in zip(*_unpacked(self.known.get()[0]).to_pydict().values())) if self.known.exists() else {}
        known = dict(before)
        if parts:
            held = pa.concat_tables(parts)
            due, later = (held.filter(side) for side in (pc.field("at") <= passed, pc.field("at") > passed))
            for task, *event in zip(*due.sort_by([("at", "ascending"), ("event_id", "ascending")]).to_pydict().values()):
                known[task], new = self.step(known.get(task), event)
                found += [(task, *x) for x in new]
            if due.num_rows:
                self.held.put([(_packed(later),)]) if later.num_rows else self.held.clear()
        for task in list(known):
            known[task], new = self.until(known[task], passed)
            found += [(task, *x) for x in new]
            if known[task] is None:
                del known[task]
        if not known:
            self.known.clear()
        elif known != before:
            kinds = pa.schema([("task", pa.string()), *((name, pa.int64()) for name in self.KNOWN)])
            self.known.update((_packed(pa.table([list(known), *map(list, zip(*known.values()))], schema=kinds)),))
        ahead = [pc.min(later["at"]).as_py()] if later is not None and later.num_rows else []
        ahead += [x for x in map(self.next, known.values()) if x is not None]
        if ahead:
            self._wake(min(ahead))
        if found:
            yield self._frame(found)

    def _frame(self, rows: list[tuple]):
        import pandas as pd

        return pd.DataFrame(rows, columns=[field.split()[0] for field in self.OUT.split(", ")])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def until(self, known, passed: int):
        """What falls due up to a time at which no event stands."""
        return known, []

    def next(self, known):
        """When something falls due without an event."""
        return None

    def close(self) -> None:
        pass


class Changes(InOrder):
    KNOWN = ["progress"]
    OUT = "task_id string, kind string, event_id bigint, progress int"

    def step(self, known, event):
        _, event_id, progress = event
        return (progress,), [] if known == (progress,) else [("change", event_id, progress)]

    def late(self, r):
        return "late", r.event_id, r.value


def fall_due(began, kept, upto: int, poll: int, keep: int):
    """(began, kept, what fell due) of deadlines before or at `upto`: a poll from `began` gives up after `poll`, a result from `kept` on goes after `keep`.

    Giving up is a result itself, which replaces an older one that is still kept.
    """
    found = []
    if began is not None and began + poll <= upto:
        end = began + poll
        if kept is not None and kept + keep < end:
            found.append(("expired", kept + keep))
        found.append(("timeout", end))
        began, kept = None, end
    if kept is not None and kept + keep <= upto:
        found.append(("expired", kept + keep))
        kept = None
    return began, kept, found


def after_event(began, kept, at: int, terminal):
    """(began, kept) after an event: a run begins with its first event and ends with a terminal one, whose result is kept."""
    return (None, at) if terminal else (at if began is None else began, kept)


class Deadlines(InOrder):
    KNOWN = ["began", "kept"]
    OUT = "task_id string, kind string, micros bigint"

    def __init__(self, poll: int, keep: int):
        self.poll, self.keep = poll, keep

    def step(self, known, event):
        began, kept, found = fall_due(*(known or (None, None)), event[0] - 1, self.poll, self.keep)
        return after_event(began, kept, event[0], event[2]), found

    def until(self, known, passed):
        began, kept, found = fall_due(*(known or (None, None)), passed, self.poll, self.keep)
        return (None if began is None and kept is None else (began, kept)), found

    def next(self, known):
        ends = [] if known is None else [x + y for x, y in zip(known, (self.poll, self.keep)) if x is not None]
        return min(ends, default=None)

    def late(self, r):
        return "late", r.at


class LiveDeadlines(StatefulProcessor):
    """The same on the wall clock, as the tasks' own relay runs: events count as they come, time-outs are processing-time timers, and a result is state that goes by its own time to live."""

    OUT = "task_id string, kind string, micros bigint"

    def __init__(self, poll: int, keep: int):
        self.poll, self.keep = poll // 1000, keep // 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", "began bigint")
        self.result = handle.getValueState("result", "state string", self.keep)
        self.goes = handle.getValueState("goes", "goes bigint")

    def _keep(self, state: str, now: int) -> None:
        self.result.update((state,))
        self.goes.update((now + self.keep,))
        self.handle.registerTimer(now + self.keep)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if r.state in TERMINAL:
                self.began.clear()
                self._keep(r.state, now)
            elif not self.began.exists():
                self.began.update((now,))
                self.handle.registerTimer(now + self.poll)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.began.exists() and self.began.get()[0] + self.poll <= at:
            self.began.clear()
            self._keep("FAILURE", at)
            yield Row(task_id=key[0], kind="timeout", micros=at * 1000)
        elif self.goes.exists() and self.goes.get()[0] <= at:
            self.goes.clear()
            yield Row(task_id=key[0], kind="expired", micros=at * 1000)

    def close(self) -> None:
        pass


def _by_bucket(events: DataFrame, value: Column, processor: InOrder) -> DataFrame:
    """Rows pass through the processor by bucket of tasks; one without a time takes no part. Their times go as numbers, so that Spark leaves late ones to it."""
    marked = timed(events).where(F.col("ts").isNotNull()).withWatermark("ts", LATENESS)
    numbers = F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(_NONE)).alias("event_id"), value.cast("bigint").alias("value")
    rows = marked.select(F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).alias("bucket"), F.col("task_id").alias("task"), *numbers)
    return rows.groupBy("bucket").transformWithStateInPandas(processor, processor.OUT, "Append", "EventTime")


def changes_in_order(events: DataFrame) -> DataFrame:
    """task_id, kind, event_id, progress of a stream: events whose clamped progress differs from the task's one before by time (`change`), and events that came behind the watermark (`late`), which change nothing."""
    return _by_bucket(events, clamp(F.col("progress")), Changes()).withColumn("event_id", F.nullif("event_id", F.lit(_NONE)))


def task_deadlines(events: DataFrame, poll_seconds: float = 7200, result_seconds: float = 3600, live: bool = False) -> DataFrame:
    """task_id, kind, micros (the time, in microseconds) of a stream of events: `timeout`, where a run has gone on for longer than it is polled, `expired`, where a result has been kept for its time, and `late` events.

    A run goes from its first event to a terminal one or its time-out, whose result is kept; a newer result replaces an
    older one. By default time is that of the events; `live` takes the wall clock, and events as they come.
    """
    poll, keep = int(poll_seconds * 1e6), int(result_seconds * 1e6)
    if not live:
        return _by_bucket(events, F.coalesce(F.col("state").isin(*TERMINAL), F.lit(False)), Deadlines(poll, keep))
    rows = timed(events).select("task_id", F.unix_micros("ts").alias("at"), "event_id", "state")
    return rows.groupBy("task_id").transformWithState(LiveDeadlines(poll, keep), LiveDeadlines.OUT, "Append", "ProcessingTime")


def run_ordered(found: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in what is there now, appends what comes of it to Parquet files under `path` and ends; run again, it goes on from the checkpoint and tells nothing twice."""
    with state_store(found.sparkSession):
        found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
