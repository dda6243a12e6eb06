"""Events that come out of order, over several runs of a stream, give what one look at all of them gives."""

import datetime
import random
import time

import pytest

from casewright.streaming import ordered, progress

SCHEMA = "event_id bigint, task_id string, ts timestamp_ntz, state string, progress int"
START = datetime.datetime(2024, 1, 1)
EPOCH = datetime.datetime(1970, 1, 1)


def micros(ts):
    return (ts - EPOCH) // datetime.timedelta(microseconds=1)


def arrivals(seed, n=240, parts=4):
    """Parts of events that come up to 30 minutes after their time, and some far too late."""
    r, out = random.Random(seed), [[] for _ in range(parts)]
    for i in range(n):
        ts = START + datetime.timedelta(minutes=i * 11, microseconds=r.randrange(10**6))
        event = (i, f"t{r.choice([0, 0, 1, 2, i])}", ts, r.choice(["PENDING", "PROGRESS", "PROGRESS", "PROGRESS", "SUCCESS", "FAILURE"]), r.choice([-5, 10, 10, 50, 120, None]))
        part = min(parts - 1, (i * 11 + r.randrange(30)) * parts // (n * 11))
        out[min(parts - 1, part + 1) if r.random() < 0.03 else part].append(event)
    for part in out:
        r.shuffle(part)
    return out


def told(parts):
    """(events in time, late ones, the final watermark) by the rule alone."""
    kept, late, passed, most = [], [], 0, None
    for part in parts:
        late += [e for e in part if micros(e[2]) <= passed]
        kept += [e for e in part if micros(e[2]) > passed]
        most = max([*(micros(e[2]) for e in part), most or 0])
        passed = (most // 1000 - 3_600_000) * 1000
    return sorted(kept, key=lambda e: (e[2], e[0])), late, passed


def run(spark, tmp_path, parts, make):
    """Takes in part after part, each by a query of its own that goes on from the checkpoint, and once more without new events."""
    for part in [*parts, []]:
        if part:
            spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
        found = make(stream)
        ordered.run_ordered(found, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return sorted((tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()), key=str)


def test_changes_across_batches(spark, tmp_path):
    parts = arrivals(1)
    kept, late, passed = told(parts)
    clamped = lambda p: 100 if p is None else max(0, min(100, p))
    want, last = [(e[1], "late", e[0], clamped(e[4])) for e in late], {}
    for i, task, ts, _, p in (e for e in kept if micros(e[2]) <= passed):
        if last.get(task, -1) != clamped(p):
            want.append((task, "change", i, clamped(p)))
        last[task] = clamped(p)
    assert late and run(spark, tmp_path, parts, ordered.changes_in_order) == sorted(want, key=str)


def test_deadlines_fire_once(spark, tmp_path):
    parts = arrivals(2)
    kept, late, passed = told(parts)
    poll, keep, want = 40 * 60_000_000, 25 * 60_000_000, [(e[1], "late", micros(e[2])) for e in late]
    for task in {e[1] for e in kept}:
        began = result = None
        moments = {micros(e[2]): e for e in kept if e[1] == task and micros(e[2]) <= passed}
        todo = sorted(moments)
        while True:  # one thing after another: an event before what falls due in the same microsecond, giving up before going
            dues = [(x, order, kind) for x, order, kind in ((todo[0] if todo else None, 0, "event"), (None if began is None else began + poll, 1, "timeout"), (None if result is None else result + keep, 2, "expired")) if x is not None and x <= passed]
            if not dues:
                break
            at, _, kind = min(dues)
            if kind == "event":
                todo.pop(0)
                if moments[at][3] in ("SUCCESS", "FAILURE"):
                    began, result = None, at
                elif began is None:
                    began = at
            else:
                want.append((task, kind, at))
                began, result = (None, at) if kind == "timeout" else (began, None)
    got = run(spark, tmp_path, parts, lambda s: ordered.task_deadlines(s, 2400, 1500))
    assert got == sorted(want, key=str) and {k for _, k, _ in got} == {"timeout", "expired", "late"}


def test_live_deadlines_by_the_clock(spark, tmp_path):
    rows = [(1, "runs", START, "PENDING", 0), (2, "ends", START, "PROGRESS", 5), (3, "ends", START, "SUCCESS", 100)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = progress.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    with ordered.state_store(spark):
        job = ordered.task_deadlines(stream, 4, 2, live=True).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="1 second").start()
    try:
        want, end = {("runs", "timeout"), ("runs", "expired"), ("ends", "expired")}, time.time() + 90
        while time.time() < end and {(r.task_id, r.kind) for r in spark.table("live").collect()} != want:
            time.sleep(1)
    finally:
        job.stop()
    got = [(r.task_id, r.kind) for r in spark.table("live").orderBy("micros").collect()]
    assert set(got) == want and len(got) == 3 and got.index(("runs", "timeout")) < got.index(("runs", "expired"))


def test_the_session_keeps_its_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with pytest.raises(ZeroDivisionError), ordered.state_store(spark):
        assert "RocksDB" in spark.conf.get(key)
        1 / 0
    assert spark.conf.get(key, None) == before


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = progress.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    ordered.run_ordered(ordered.task_deadlines(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.schema("task_id string, kind string, micros bigint").parquet(str(tmp_path / "out")).count() == 0


def test_tasks_share_states(spark, tmp_path):
    """However many tasks there are, states are as many as buckets at most."""
    rows = [(i, f"t{i}", START, "PENDING", i % 100) for i in range(1500)]
    assert run(spark, tmp_path, [rows], ordered.changes_in_order) == []
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "checkpoint"))
    assert 100 < held.select("key").distinct().count() <= 512


def test_missing_values(spark, tmp_path):
    """Events without an id or a task count, ones without a time take no part; large ids stay exact."""
    later, big = START + datetime.timedelta(hours=9), 2**62 + 1
    rows = [(None, "a", START, "SUCCESS", 5), (big, "a", START + datetime.timedelta(minutes=1), None, 7), (3, None, START, "PENDING", None), (4, "a", None, "PENDING", 1), (5, "b", later, "PENDING", 0)]
    want = [("a", "change", None, 5), ("a", "change", big, 7), (None, "change", 3, 100)]
    assert run(spark, tmp_path / "c", [rows], ordered.changes_in_order) == sorted(want, key=str)
    t = micros(START)
    want = [("a", "expired", t + 3_600_000_000), ("a", "timeout", t + 7_260_000_000), ("a", "expired", t + 10_860_000_000), (None, "timeout", t + 7_200_000_000), (None, "expired", t + 10_800_000_000)]
    assert run(spark, tmp_path / "d", [rows], ordered.task_deadlines) == sorted(want, key=str)


def test_deadlines_share_states(spark, tmp_path):
    """What is known of tasks is one state for each bucket, and gone once nothing of its tasks can fall due."""
    rows = [(i, f"t{i}", START, "PENDING", 0) for i in range(1500)] + [(9999, "last", START + datetime.timedelta(minutes=90), "PENDING", 0)]
    assert run(spark, tmp_path, [rows], ordered.task_deadlines) == []
    read = spark.read.format("statestore").option("stateVarName", "known")
    assert 100 < read.load(str(tmp_path / "checkpoint")).select("key").distinct().count() <= 512
    spark.createDataFrame([(10000, "last", START + datetime.timedelta(hours=9), "PENDING", 0)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    assert len(run(spark, tmp_path, [], ordered.task_deadlines)) == 3002
    assert read.load(str(tmp_path / "checkpoint")).count() == 0
