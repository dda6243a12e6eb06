"""Queries over the events table as a stream that comes in several parts, out of order and partly late."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.plans.registry import query
from casewright.sources import partitions
from casewright.sources.relations import load
from casewright.sources.chunk_store import ChunkStore
from casewright.sources.storage import scratch_path
from casewright.streaming import ordered, progress, upserts

#: Days of arrivals in each of the parts; an event arrives up to half an hour late, every 97th with the part after its own.
_DAYS, _PARTS = 10, 3
_PART = "CAST(floor((epoch_us(ts) + (event_id * 7919 % 1800) * 1000000 - low) / {d}) AS INT) + CASE WHEN event_id % 97 = 5 THEN 1 ELSE 0 END"
#: w: the watermark that a part finds; kept: events that come before it has passed them; last: the final watermark.
_ARRIVED = f"""
+ b AS (SELECT min(epoch_us(ts)) AS low FROM task_events),
p AS (SELECT *, epoch_us(ts) AS us, least({_PART.format(d=_DAYS * 86_400_000_000)}, {_PARTS - 1}) AS part FROM task_events, b),
w AS (SELECT part, lag(max(most)) OVER (ORDER BY part) AS passed FROM (SELECT part, max(max(us)) OVER (ORDER BY part) AS most FROM p GROUP BY part) GROUP BY part),
m AS (SELECT part, coalesce((passed // 1000 - 3600000) * 1000, 0) AS passed FROM w),
kept AS (SELECT p.* FROM p JOIN m USING (part) WHERE us > passed), gone AS (SELECT p.* FROM p JOIN m USING (part) WHERE us <= passed),
last AS (SELECT (max(us) // 1000 - 3600000) * 1000 AS mark FROM p)"""


def _parts(spark, sf_dir):
    """Takes the events in part by part, as they would arrive; yields a fresh reader of the stream each time, and the folder of its results."""
    events, base = load(spark, sf_dir, "task_events"), scratch_path(spark, "arrivals")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low = events.agg(F.min(at)).first()[0]
    part = F.floor((at + (F.col("event_id") * 7919 % 1800) * 1_000_000 - F.lit(low)) / (_DAYS * 86_400_000_000)).cast("int") + F.when(F.col("event_id") % 97 == 5, 1).otherwise(0)
    events.withColumn("part", F.least(part, F.lit(_PARTS - 1))).write.partitionBy("part").parquet(f"{base}/parts")
    for k in range(_PARTS):
        partitions.replace(spark, f"{base}/parts/part={k}", f"{base}/in/part={k}")
        yield progress.read_stream(spark, f"{base}/in", events.schema), base


@query("task_events", sql=_ARRIVED + """,
c AS (SELECT *, CASE WHEN progress < 0 THEN 0 WHEN progress > 100 THEN 100 ELSE progress END AS now FROM kept, last WHERE us <= mark),
l AS (SELECT *, lag(now) OVER (PARTITION BY task_id ORDER BY us, event_id) AS before, row_number() OVER (PARTITION BY task_id ORDER BY us, event_id) AS i FROM c)
SELECT task_id, 'change' AS kind, event_id, now AS progress FROM l WHERE i = 1 OR now <> before
UNION ALL SELECT task_id, 'late', event_id, CASE WHEN progress < 0 THEN 0 WHEN progress > 100 THEN 100 ELSE progress END FROM gone""")
def stream_changes_in_order(spark, sf_dir):
    """Progress changes by event time across the parts of a stream; late events are told apart."""
    for events, base in _parts(spark, sf_dir):
        found = ordered.changes_in_order(events)
        ordered.run_ordered(found, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{base}/out")


#: Runs and results of a task by recursion over its events: b began, r kept; e, d, x fell due before the event at t.
_DEADLINES = """,
s AS (SELECT task_id, us, event_id, state FROM kept, last WHERE us <= mark UNION ALL SELECT DISTINCT task_id, mark + 1, 9223372036854775807, 'END' FROM kept, last WHERE us <= mark),
n AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY us, event_id) AS i FROM s),
g AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS d, CAST(NULL AS BIGINT) AS x FROM n
  UNION ALL SELECT task_id, i, CASE WHEN state IN ('SUCCESS', 'FAILURE') THEN NULL WHEN d IS NOT NULL OR b IS NULL THEN t ELSE b END,
    CASE WHEN state IN ('SUCCESS', 'FAILURE') THEN t WHEN x IS NOT NULL THEN NULL WHEN d IS NOT NULL THEN d WHEN e IS NOT NULL THEN NULL ELSE r END, e, d, x
  FROM (SELECT n.task_id, n.i, n.state, n.us AS t, g.b, g.r, CASE WHEN g.b + 7200000000 < n.us THEN g.b + 7200000000 END AS d,
      CASE WHEN g.r + 3600000000 < CASE WHEN g.b + 7200000000 < n.us THEN g.b + 7200000000 ELSE n.us END THEN g.r + 3600000000 END AS e,
      CASE WHEN g.b + 7200000000 < n.us AND g.b + 10800000000 < n.us THEN g.b + 10800000000 END AS x FROM g JOIN n ON n.task_id = g.task_id AND n.i = g.i + 1) q)"""


@query("task_events", sql=_ARRIVED + _DEADLINES + """
SELECT task_id, 'timeout' AS kind, d AS micros FROM g WHERE d IS NOT NULL UNION ALL SELECT task_id, 'expired', e FROM g WHERE e IS NOT NULL
UNION ALL SELECT task_id, 'expired', x FROM g WHERE x IS NOT NULL UNION ALL SELECT task_id, 'late', us FROM gone""", recursive=True)
def stream_task_deadlines(spark, sf_dir):
    """Polls given up after two hours and results gone after one, fired by timers while the stream comes in parts."""
    for events, base in _parts(spark, sf_dir):
        found = ordered.task_deadlines(events)
        ordered.run_ordered(found, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{base}/out")


_EVENT = """
+ e AS (SELECT id, k AS seq, CASE k WHEN 1 THEN 'started' WHEN 2 THEN CASE WHEN id % 7 = 3 THEN 'failed' ELSE 'completed' END WHEN 3 THEN 'reset' ELSE 'completed' END AS event,
  CASE WHEN k = 0 THEN 99 ELSE chunks_count END AS chunks_count, error_message, id * 10 + k AS moment FROM files, (VALUES (0), (1), (2), (3)) v(k)
  WHERE k = 1 OR (k = 2 AND id % 2 = 1) OR (k = 3 AND id % 5 = 0) OR (k = 0 AND id % 3 = 0))"""


@query("files", sql=_EVENT + """,
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM e)
SELECT id, seq, CASE event WHEN 'started' THEN 'indexing' WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'error' ELSE 'pending' END AS indexing_status, CASE WHEN event = 'completed' THEN chunks_count ELSE 0 END AS chunks_count,
  CASE WHEN event = 'failed' THEN coalesce(error_message, '') END AS error_message, CASE WHEN event IN ('completed', 'failed') THEN moment END AS completed_at FROM l WHERE rn = 1""")
def stream_file_states(spark, sf_dir):
    """The files' rows as a stream of indexing events leaves them: started, ended, set back, and old events that come last and change nothing."""
    files, base, k = load(spark, sf_dir, "files"), scratch_path(spark, "file-events"), F.col("k")
    rows = files.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).where((k == 1) | ((k == 2) & (F.col("id") % 2 == 1)) | ((k == 3) & (F.col("id") % 5 == 0)) | ((k == 0) & (F.col("id") % 3 == 0)))
    event = F.when(k == 1, "started").when(k == 2, F.when(F.col("id") % 7 == 3, "failed").otherwise("completed")).when(k == 3, "reset").otherwise("completed")
    events = rows.select("id", k.alias("seq"), event.alias("event"), F.when(k == 0, 99).otherwise(F.col("chunks_count")).alias("chunks_count"), "error_message", (F.col("id") * 10 + k).alias("at"))
    events.write.partitionBy("seq").parquet(f"{base}/parts")
    table = upserts.KeyedTable(f"{base}/table", upserts.file_changes(events).schema, ["id"], "seq")
    for seq in (1, 2, 3, 0):
        partitions.replace(spark, f"{base}/parts/seq={seq}", f"{base}/in/seq={seq}")
        table.follow(upserts.file_changes(progress.read_stream(spark, f"{base}/in", events.schema)), f"{base}/checkpoint")
    return table.read(spark)


@query("chunks", sql="""
+ s AS (SELECT application_id, document_id, chunk_index, CASE WHEN document_id % 50 = 4 THEN concat('new ', text) ELSE text END AS text FROM chunks WHERE NOT (document_id % 50 = 4 AND chunk_index > 1)),
d AS (SELECT * FROM s WHERE NOT (document_id % 30 = 1 OR document_id % 30 = 2 OR document_id % 50 = 9 OR application_id = 7))
SELECT application_id, document_id, count(*) AS n, md5(string_agg(text, '' ORDER BY chunk_index)) AS texts FROM d GROUP BY ALL""")
def chunk_store_edits(spark, sf_dir):
    """A chunk store by case: all chunks indexed, some documents indexed anew, files deleted by their id or by their document where no chunk names them, documents and a whole case deleted."""
    doc = F.col("document_id")
    rows = load(spark, sf_dir, "chunks").select("application_id", "document_id", F.when(doc % 3 != 0, F.concat(F.lit("f"), doc.cast("string"))).alias("file_id"), "chunk_index", "text")
    store = ChunkStore(spark, f"{scratch_path(spark, 'store')}/chunks", rows.schema)
    store.index(rows)
    store.index(rows.where((doc % 50 == 4) & (F.col("chunk_index") <= 1)).withColumn("text", F.concat(F.lit("new "), "text")))
    store.delete_files(rows.where(doc % 30 <= 2).where(doc % 30 >= 1).select("application_id", F.concat(F.lit("f"), doc.cast("string")).alias("file_id"), "document_id").distinct())
    store.delete_documents(rows.where(doc % 50 == 9).select("application_id", "document_id").distinct())
    store.delete_cases([7])
    texts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    return store.read().groupBy("application_id", "document_id").agg(F.count("*").alias("n"), F.md5(F.array_join(texts, "")).alias("texts"))
