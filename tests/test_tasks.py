"""Calls that fail, merged meta, reports and analyses that are stopped, on small fixtures."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from casewright.operators import extraction, report, retrieval, status, tasks


def test_calls_that_fail_are_rows_and_the_others_go_on(spark):
    def send(model, prompt, attempt):
        if prompt == "never" or prompt == "later" and attempt == 1:
            raise ValueError(f"{model} is busy")
        return f"{prompt}!", len(prompt)

    rows = [(i, "m", p) for i, p in enumerate(["now", "later", "never", "now", "now"])] + [(None, None, "now")]
    got = tasks.call_model(spark.createDataFrame(rows, "request bigint, model string, prompt string"), send, retries=1).collect()
    told = sorted((tuple(r) for r in got), key=str)
    assert told == sorted([(0, "m", "now!", 3, None, 1), (1, "m", "later!", 5, None, 2), (2, "m", None, None, "ValueError: m is busy", 2), (3, "m", "now!", 3, None, 1), (4, "m", "now!", 3, None, 1), (None, None, "now!", 3, None, 1)], key=str)


def test_so_many_calls_at_once(spark, tmp_path):
    def send(model, prompt, attempt):
        mine = tmp_path / prompt
        mine.write_text("")
        time.sleep(0.05)
        n = len(list(tmp_path.iterdir()))
        mine.unlink()
        return str(n), 1

    rows = [(i, "m", f"p{i}") for i in range(24)]
    requests = spark.createDataFrame(rows, "request bigint, model string, prompt string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        most = max(int(r.response) for r in tasks.call_model(requests, send, concurrency=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert 1 < most <= 3


def test_last_wins(spark):
    rows = [("a", 1, {"x": "1", "y": "1"}), ("a", 3, {"x": "3"}), ("a", 2, {"x": "2", "z": None}), ("a", 3, {"x": "30"}), ("b", 1, {}), ("c", 1, None)]
    df = spark.createDataFrame(rows, "task_id string, seq int, meta map<string,string>")
    assert {r.task_id: r.meta for r in tasks.merged_meta(df).collect()} == {"a": {"x": "30", "y": "1", "z": None}, "b": {}, "c": {}}
    maps = spark.createDataFrame([({"x": "1", "y": "2"}, {"x": "3"}), (None, {"x": "3"}), ({"x": "1"}, None), (None, None)], "l map<string,string>, r map<string,string>")
    assert [r[0] for r in maps.select(tasks.last_wins(F.col("l"), F.col("r"))).collect()] == [{"x": "3", "y": "2"}, {"x": "3"}, {"x": "1"}, {}]
    ended = spark.createDataFrame([({"message": "own", "n": "1"},), (None,)], "m map<string,string>").select(tasks.ended_meta(F.col("m")).alias("m")).collect()
    assert [r.m for r in ended] == [{"progress": "100", "stage": "complete", "message": "own", "n": "1"}, tasks.ENDED]


def test_a_stopped_analysis_keeps_whole_parts_and_goes_on(spark, tmp_path):
    jobs = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "id bigint, v string")
    made = spark.sparkContext.accumulator(0)
    path, slow = str(tmp_path / "parts"), tmp_path / "slow"
    slow.write_text("")
    halt = str(slow)

    def work(df):
        def run(batches):
            import os

            for batch in batches:
                made.add(batch.num_rows)
                if os.path.exists(halt) and 17 in batch.column(0).to_pylist():
                    time.sleep(60)
                yield batch

        return df.mapInArrow(run, df.schema)

    whole = tasks.run_in_parts(jobs, lambda df: df, str(tmp_path / "whole"), ["id"], parts=5)
    failed = []

    def analyse():
        try:
            tasks.run_in_parts(jobs, work, path, ["id"], parts=5, tag="stoppable")
        except Exception as e:  # noqa: BLE001  what an interrupted job raises
            failed.append(e)

    thread = threading.Thread(target=analyse)
    thread.start()
    where = next(k for k in range(5) if jobs.where((F.pmod(F.xxhash64("id"), F.lit(5)) == k) & (F.col("id") == 17)).count())
    end = time.time() + 60
    while thread.is_alive() and time.time() < end:
        if all((tmp_path / "parts" / f"part={k}" / "_SUCCESS").exists() for k in range(where)):
            time.sleep(3)
            tasks.stop(spark, "stoppable")
        time.sleep(0.5)
    thread.join(30)
    done = {k for k in range(5) if (tmp_path / "parts" / f"part={k}" / "_SUCCESS").exists()}
    assert failed and done == set(range(where))
    slow.unlink()
    before, kept = made.value, spark.read.schema(jobs.schema).parquet(*(f"{path}/part={k}" for k in done)).count() if done else 0
    got = tasks.run_in_parts(jobs, work, path, ["id"], parts=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) == [(i, f"v{i}") for i in range(40)]
    assert made.value - before == 40 - kept


def test_requests_are_dealt_out_without_their_salt(spark):
    """What is shuffled are the requests' own columns; rows of a model lie together, over several tasks; repeated, empty and null ones are sent as they are."""
    rows = [(i, "m" if i % 50 else None, f"p{i}") for i in range(300)] + [(1, "m", "p1")] * 2 + [(None, None, None), (400, "n", ""), (400, "", None)]
    requests = spark.createDataFrame(rows, "request bigint, model string, prompt string").repartition(3)

    def provider(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for k, batch in enumerate(batches):
            places = [TaskContext.get().partitionId() * 1_000_000 + k * 10_000 + i for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=["request", "model", "prompt", "place"])

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sent = extraction.ask(requests, provider, "request bigint, model string, prompt string, place bigint")
        assert "salt" not in sent._jdf.queryExecution().executedPlan().toString()
        got = sorted(sent.collect(), key=lambda r: r.place)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(str, (r[:3] for r in got))) == sorted(map(str, rows))
    assert len({r.place // 1_000_000 for r in got if r.model == "m"}) > 1
    for task in {r.place // 1_000_000 for r in got}:
        models = [r.model for r in got if r.place // 1_000_000 == task]
        assert sum(a != b for a, b in zip(models, models[1:])) == len({*models}) - 1


def test_nested_reports_in_both_views(spark):
    frame = spark.createDataFrame
    links = frame([(1, 1), (1, 2), (2, 1), (2, 3)], "application_id bigint, checklist_id bigint")
    lists = frame([(1, "one"), (2, 'tw"o'), (3, "none")], "id bigint, name string")
    parameters = frame([(10, 1, "b", 1), (11, 1, "a", 0), (20, 2, "c", 0)], "id bigint, checklist_id bigint, name string, order_index int")
    results = frame([(5, 1, 10, "late", 0.5), (4, 1, 10, "first", 0.5), (6, 1, 20, None, 0.1), (7, 2, 20, "not linked", 0.2)], "id bigint, application_id bigint, parameter_id bigint, value string, confidence double")
    read = lambda full: {r.application_id: (r.n_results, json.loads(r.report)) for r in report.nested_reports(links, lists, parameters, results, full).collect()}
    own = {"name": "b", "value": "first", "confidence": 0.5}
    assert read(False) == {1: (1, [{"checklist_id": 1, "name": "one", "total": 2, "parameters": [own]}])}
    empty = lambda n: {"name": n, "value": None, "confidence": None}
    assert read(True) == {
        1: (1, [{"checklist_id": 1, "name": "one", "total": 2, "parameters": [empty("a"), own]}, {"checklist_id": 2, "name": 'tw"o', "total": 1, "parameters": [empty("c")]}]),
        2: (0, [{"checklist_id": 1, "name": "one", "total": 2, "parameters": [empty("a"), empty("b")]}, {"checklist_id": 3, "name": "none", "total": 0, "parameters": []}]),
    }


def test_detailed_hits_of_one_and_several_cases(spark):
    hits = spark.createDataFrame([(1, 1, 1, "t", 5, 2, 0.123456, 0.98765, "s", "text"), (1, 2, 2, None, None, None, None, None, None, None)], "application_id int, position int, global_position int, text string, document_id bigint, page_number int, score double, rerank_score double, section string, content_type string")
    names = spark.createDataFrame([(5, "doc")], "document_id bigint, name string")
    one = retrieval.detailed(hits, names).orderBy("position").collect()
    assert [(r.document_name, r.page, r.score, r.rerank_score, r.metadata.section) for r in one] == [("doc", "2", 0.1235, 0.9877, "s"), ("Неизвестный документ", "Не указана", 0.0, None, None)]
    assert "rerank_score" not in retrieval.detailed(hits, names, "global_position").columns


@pytest.mark.parametrize("state,operation,want", [("indexed", None, "m (1 мин. 5 сек.)"), ("analyzed", None, "m (50 сек.)"), ("error", "indexing", "m (выполнялось 2 мин. 45 сек.)"), ("error", "analyzing", "m (выполнялось 50 сек.)"), ("error", None, "m"), ("created", None, "m")])
def test_status_messages(spark, state, operation, want):
    moments = "timestamp_ntz'2024-01-01 00:00:00'"
    files = spark.sql(f"SELECT 1 AS application_id, {moments} AS indexing_started_at, {moments} + INTERVAL 65 SECONDS AS indexing_completed_at UNION ALL SELECT 1, {moments}, NULL UNION ALL SELECT 1, NULL, NULL")
    apps = spark.createDataFrame([(1, state, operation, "m"), (2, state, operation, None)], "id int, status string, last_operation string, status_message string").selectExpr("*", f"{moments} AS analysis_started_at", f"{moments} + INTERVAL 50 SECONDS AS analysis_completed_at")
    got = {r.id: r.message for r in status.status_messages(apps, files, F.lit("2024-01-01 00:01:40").cast("timestamp_ntz")).collect()}
    assert got == {1: want, 2: None}


def test_partial_reports_deal_rows_out_seldom(spark):
    from casewright.operators import report

    frame = spark.createDataFrame
    links = frame([(1, 1)], "application_id bigint, checklist_id bigint")
    lists, parameters = frame([(1, "a")], "id bigint, name string"), frame([(1, 1, "p", 0)], "id bigint, checklist_id bigint, name string, order_index int")
    results = frame([(1, 1, 1, "v", 0.5)], "id bigint, application_id bigint, parameter_id bigint, value string, confidence double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = report.nested_reports(links, lists, parameters, results)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 7


def test_few_checklists_meet_the_reports(spark, monkeypatch):
    """Parameters are not dealt out by checklist to be counted or named where checklists are few; with many, reports are the same, also of repeated, unnamed and null ones."""
    frame = spark.createDataFrame
    links = frame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 3), (3, None), (None, 1)], "application_id bigint, checklist_id bigint")
    lists = frame([(1, "one"), (1, "uno"), (1, None), (2, None), (3, "none"), (None, "x")], "id bigint, name string")
    parameters = frame([(10, 1, "b", 1), (10, 1, "b", 1), (11, 1, "", 0), (20, 2, None, None), (30, 4, "unknown", 0), (40, None, "n", 0), (None, 2, "m", 0)], "id bigint, checklist_id bigint, name string, order_index int")
    results = frame([(5, 1, 10, "late", 0.5), (4, 1, 10, "first", 0.5), (4, 1, 10, "first", 0.5), (6, 1, 20, "", None), (7, 2, 20, "not linked", 0.2), (8, 2, 11, "v", 0.1), (9, 1, 11, None, 0.3), (10, 3, 40, "w", 0.1), (11, None, 10, "w", 0.1), (12, 1, None, "w", 0.1)], "id bigint, application_id bigint, parameter_id bigint, value string, confidence double")
    read = lambda: {r.application_id: (r.n_results, r.report) for r in report.nested_reports(links, lists, parameters, results).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = report.nested_reports(links, lists, parameters, results)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin [checklist_id" not in plan.split("SortMergeJoin [application_id")[0]
        few = read()
        monkeypatch.setattr(report, "FEW", 1)
        assert few == read() and "Window" in report.nested_reports(links, lists, parameters, results)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    told = {case: (n, [(x["checklist_id"], x["name"], x["total"], [(y["name"], y["value"], y["confidence"]) for y in x["parameters"]]) for x in json.loads(text)]) for case, (n, text) in few.items()}
    assert told == {
        1: (7, [(1, "uno", 3, [("b", "first", 0.5)] * 6), (2, None, 2, [(None, "", None)])]),
        2: (3, [(1, "uno", 3, [("", "v", 0.1)] * 3)]),
    }
