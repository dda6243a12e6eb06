"""Tables of which only what changes is rewritten."""

import os
import random

from pyspark.sql import functions as F

from casewright.sources.chunk_store import ChunkStore
from casewright.streaming import progress, upserts

CHUNK = "application_id int, document_id string, file_id string, chunk_index int, text string"
ROW = "id bigint, part string, seq int, value string"


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def held(store):
    return sorted((tuple(r) for r in store.read().collect()), key=str)


def test_chunk_store_rewrites_only_touched_cases(spark, tmp_path):
    rows = [(c, f"d{d}", None if d == 2 else f"f{d}", i, f"{c}-{d}-{i}") for c in (1, 2, 3) for d in (1, 2, 3) for i in range(2)]
    frame = lambda x: spark.createDataFrame(x, CHUNK)
    store = ChunkStore(spark, str(tmp_path / "store"), frame([]).schema)
    assert held(store) == []
    store.index(frame(rows))
    assert held(store) == sorted(rows, key=str)
    before = files_of(store.path)

    new = [(2, "d1", "f1", 0, "again"), (2, "d4", "f4", 0, "more")]
    store.index(frame(new))
    rows = [r for r in rows if r[:2] != (2, "d1")] + new
    after = files_of(store.path)
    assert held(store) == sorted(rows, key=str)
    assert {f for f in before if "application_id=2" not in f} <= after.keys() and all(after[f] == t for f, t in before.items() if "application_id=2" not in f)

    wanted = spark.createDataFrame([(1, "f1", "d9"), (1, "f2", "d2"), (3, "f7", "d7"), (9, "f1", "d1")], "application_id int, file_id string, document_id string")
    store.delete_files(wanted)  # by file; by document, as no chunk names f2; nothing; no such case
    rows = [r for r in rows if r[:2] not in {(1, "d1"), (1, "d2")}]
    assert held(store) == sorted(rows, key=str)
    store.delete_documents(spark.createDataFrame([(1, "d3"), (2, "d3")], "application_id int, document_id string"))
    rows = [r for r in rows if r[:2] not in {(1, "d3"), (2, "d3")}]
    assert held(store) == sorted(rows, key=str) and not os.path.isdir(f"{store.path}/application_id=1")
    store.delete_cases([2, 5])
    assert held(store) == sorted((r for r in rows if r[0] == 3), key=str)
    store.index(frame([]))
    assert held(store) == sorted((r for r in rows if r[0] == 3), key=str)
    plan = store.read().where("application_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(application_id" in plan


def table(spark, tmp_path):
    return upserts.KeyedTable(str(tmp_path / "table"), spark.createDataFrame([], ROW).schema, ["id", "part"], "seq", buckets=8)


def test_merges_keep_the_latest_and_repeated_batches_write_nothing(spark, tmp_path):
    r, t, want = random.Random(1), table(spark, tmp_path), {}
    assert t.read(spark).count() == 0
    for _ in range(4):
        batch = [(r.randrange(40), r.choice(["a", None]), r.randrange(6), r.choice(["x", "y", None])) for _ in range(30)]
        for row in batch:
            k, rank = row[:2], (row[2], row[3] is not None, row[3] or "")
            if k not in want or rank > want[k][0]:
                want[k] = (rank, row)
        frame = spark.createDataFrame(batch, ROW)
        t.merge(frame)
        assert sorted((tuple(x) for x in t.read(spark).collect()), key=str) == sorted((row for _, row in want.values()), key=str)
        before = files_of(t.path)
        t.merge(frame)
        t.merge(frame.limit(0))
        assert files_of(t.path) == before


def test_bytes_written_follow_the_batch(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(spark.range(4000).select("id", F.lit("a").alias("part"), F.lit(1).alias("seq"), F.col("id").cast("string").alias("value")))
    before = files_of(t.path)
    t.merge(spark.createDataFrame([(7, "a", 2, "new")], ROW))
    after = files_of(t.path)
    assert len({f.rsplit("/", 1)[0] for f in before.keys() - after.keys()}) == 1
    assert {x.value for x in t.read(spark).where("id = 7").collect()} == {"new"} and t.read(spark).count() == 4000


def test_a_batch_is_written_once_and_dealt_out_once(spark, tmp_path):
    t, n = table(spark, tmp_path), []
    rows = spark.range(4000).select("id", F.lit("a").alias("part"), F.lit(1).alias("seq"), F.col("id").cast("string").alias("value"))
    t.merge(rows)
    tracker = spark.sparkContext.statusTracker()
    for k in range(2):
        spark.sparkContext.setJobGroup(f"merge-{k}", "merge")
        t.merge(rows.withColumn("seq", F.lit(2)) if k else rows.limit(0))
        jobs = tracker.getJobIdsForGroup(f"merge-{k}")
        n.append(sum(tracker.getStageInfo(s).numTasks > 0 and tracker.getStageInfo(s).numCompletedTasks > 0 for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Buckets asked for (2 stages), rows dealt out and written (2), folders that changed (2).
    assert n[1] <= 8 and {r.seq for r in t.read(spark).select("seq").distinct().collect()} == {2}


def test_a_stream_that_is_started_again_goes_on(spark, tmp_path):
    t = table(spark, tmp_path)
    for k, rows in enumerate(([(1, "a", 1, "x"), (2, "a", 1, "x")], [(1, "a", 2, "y"), (2, "a", 0, "old")], [])):
        if rows:
            spark.createDataFrame(rows, ROW).write.mode("append").parquet(str(tmp_path / "in"))
        t.follow(progress.read_stream(spark, str(tmp_path / "in"), t.schema), str(tmp_path / "checkpoint"))
    assert sorted(tuple(r) for r in t.read(spark).collect()) == [(1, "a", 2, "y"), (2, "a", 1, "x")]


def test_a_migration_that_is_run_twice_changes_nothing(spark, tmp_path):
    from casewright.sources import tables

    name, old = "migrated_lists", spark.createDataFrame([(1, "one")], "id bigint, Name string")
    try:
        tables.create_table(old, name, str(tmp_path / "table"))
        tables.create_table(old.limit(0), name, str(tmp_path / "other"))
        wanted = {"name": ("STRING", "'x'"), "user_id": ("BIGINT", None), "is_public": ("BOOLEAN", "false")}
        before = files_of(str(tmp_path / "table"))
        assert tables.add_missing_columns(spark, name, wanted) == ["user_id", "is_public"]
        assert tables.add_missing_columns(spark, name, wanted) == []
        assert files_of(str(tmp_path / "table")) == before
        assert [tuple(r) for r in spark.table(name).collect()] == [(1, "one", None, False)]
        spark.createDataFrame([(2, "two", 7, True)], "id bigint, name string, user_id bigint, is_public boolean").write.insertInto(name)
        assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "one", None, False), (2, "two", 7, True)]
        assert tables.columns_of(spark, name) == {"id": "bigint", "Name": "string", "user_id": "bigint", "is_public": "boolean"}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
