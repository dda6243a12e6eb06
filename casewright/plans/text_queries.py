"""Queries over model answers and task events."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import answers
from casewright.operators import status
from casewright.plans.registry import query
from casewright.sources.relations import load
from casewright.sources.storage import scratch_path
from casewright.streaming import progress

_CONF = "list_reduce(list_prepend(0.7::DOUBLE, list_transform(list_filter([{}], lambda p: contains(lower({{t}}), p)), lambda p: -0.1::DOUBLE)), lambda a, b: a + b)".format(", ".join(f"'{p}'" for p in answers.DOUBT_PHRASES))
_DOUBT = "len(list_filter([{}], lambda p: contains(lower({{t}}), p))) > 0".format(", ".join(f"'{p}'" for p in answers.DOUBT_PHRASES))
_SCORE = f"round(greatest(0.1, least(1.0, {_CONF} + CASE WHEN length({{t}}) < 100 AND NOT ({_DOUBT}) THEN 0.1 ELSE 0 END)), 4)"
_MISSING = " OR ".join(f"contains(lower(t), '{p}')" for p in answers.NOT_FOUND_PHRASES)
_STRIP = "regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS t"


def _doubtful(df):
    """Injects phrases of doubt by id, which the driver's texts lack."""
    n, phrases = len(answers.DOUBT_PHRASES), F.array(*(F.lit(p) for p in answers.DOUBT_PHRASES))
    pick = lambda k: F.element_at(phrases, (F.col("conv_id") * k % n + 1).cast("int"))
    return df.withColumn("response", F.when(F.col("conv_id") % 3 == 0, F.concat_ws(" ", pick(1), "response", pick(3))).otherwise(F.col("response")))


_PHRASES = ", ".join(f"'{p}'" for p in answers.DOUBT_PHRASES)
_DOUBTFUL = f"d AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN concat_ws(' ', [{_PHRASES}][conv_id % 11 + 1], response, [{_PHRASES}][conv_id * 3 % 11 + 1]) ELSE response END AS response FROM llm_answers)"


@query("llm_answers", sql=f"+ {_DOUBTFUL} SELECT conv_id, turn, {_SCORE.format(t='response')} AS confidence FROM d")
def confidence_heuristic(spark, sf_dir):
    rows = _doubtful(load(spark, sf_dir, "llm_answers"))
    return rows.select("conv_id", "turn", F.round(answers.confidence(F.col("response")), 4).alias("confidence"))


@query("llm_answers", sql=f"""+ {_DOUBTFUL}, s AS (SELECT conv_id, turn, response, {_STRIP} FROM d),
p AS (SELECT *, regexp_extract(t, '(?i)результат:\\s*(.+)', 1) AS a, regexp_extract(t, '(?i)ответ:\\s*(.+)', 1) AS b, regexp_extract(t, '(?i)значение:\\s*(.+)', 1) AS c FROM s)
SELECT conv_id, turn, CASE WHEN response = '' OR {_MISSING} THEN 'Информация не найдена' WHEN a <> '' THEN trim(a) WHEN b <> '' THEN trim(b) WHEN c <> '' THEN trim(c) ELSE t END AS value,
  CASE WHEN response = '' THEN 0.0 WHEN {_MISSING} THEN 0.1 WHEN a <> '' OR b <> '' OR c <> '' THEN 0.9 ELSE {_SCORE.format(t='t')} END AS confidence,
  CASE WHEN response = '' THEN 'empty' WHEN {_MISSING} THEN 'not_found' WHEN a <> '' OR b <> '' OR c <> '' THEN 'result_prefix' ELSE 'plain_text' END AS format FROM p""")
def parse_answers_native(spark, sf_dir):
    rows = _doubtful(load(spark, sf_dir, "llm_answers")).withColumn("p", answers.parse_native(F.col("response")))
    return rows.select("conv_id", "turn", "p.value", F.round("p.confidence", 4).alias("confidence"), "p.format")


@query("llm_answers", sql=f"""+ s AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, response, {_STRIP} FROM llm_answers)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'v' || conv_id WHEN 1 THEN CAST(turn AS VARCHAR) WHEN 2 THEN 'v' || conv_id WHEN 3 THEN CAST(conv_id AS VARCHAR) WHEN 5 THEN 'параметра ' || turn WHEN 7 THEN t ELSE 'Информация не найдена' END AS value,
  CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN 0.95 WHEN 4 THEN 0.1 WHEN 5 THEN 0.85 WHEN 6 THEN 0.0 ELSE {_SCORE.format(t='t')} END AS confidence,
  CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'json_block' WHEN 2 THEN 'result_prefix' WHEN 3 THEN 'key_value_exact' WHEN 4 THEN 'not_found' WHEN 5 THEN 'structured_single' WHEN 6 THEN 'empty' ELSE 'plain_text' END AS format,
  CASE k WHEN 0 THEN CAST(turn AS VARCHAR) END AS page FROM s""")
def parse_answers_full(spark, sf_dir):
    rows = load(spark, sf_dir, "llm_answers").withColumn("p", answers.parse_full(F.col("response"), F.col("q")))
    return rows.select("conv_id", "turn", "p.value", F.round("p.confidence", 4).alias("confidence"), "p.format", "p.page")


@query("task_events", sql="SELECT task_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(state, (ts, event_id)) AS state, arg_max(progress, (ts, event_id)) AS progress FROM task_events GROUP BY 1")
def task_latest_state(spark, sf_dir):
    return status.latest_states(load(spark, sf_dir, "task_events"))


@query("task_events", sql="""
+ m AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'Ошибка связи' ELSE 'ok' END AS message FROM task_events)
SELECT event_id, CASE state WHEN 'PENDING' THEN 'pending' WHEN 'PROGRESS' THEN 'progress' WHEN 'SUCCESS' THEN 'success' WHEN 'FAILURE' THEN 'error' END AS response,
  CASE WHEN state = 'FAILURE' OR event_id % 9 = 0 THEN 'error' WHEN state = 'SUCCESS' OR progress >= 100 THEN 'success' ELSE 'running' END AS verdict FROM m""")
def task_response(spark, sf_dir):
    rows = load(spark, sf_dir, "task_events")
    message = F.when(F.col("event_id") % 9 == 0, "Ошибка связи").otherwise("ok")
    response = status.search_response(F.col("state"))
    return rows.select("event_id", response.alias("response"), status.terminal(response, F.col("state"), F.col("progress"), message).alias("verdict"))


_CHANGES = """+ p AS (SELECT *, greatest(0, least(100, progress)) AS shown FROM task_events), l AS (SELECT *, lag(shown) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS last FROM p)
SELECT task_id, event_id, CAST(shown AS INT) AS progress FROM l WHERE last IS DISTINCT FROM shown"""


@query("task_events", sql=_CHANGES)
def progress_changes(spark, sf_dir):
    return progress.progress_changes(load(spark, sf_dir, "task_events")).select("task_id", "event_id", "progress")


@query("task_events", sql="SELECT event_id, CASE WHEN progress < 40 THEN 'low' WHEN progress < 70 THEN 'medium' WHEN progress < 90 THEN 'high' ELSE 'critical' END AS band FROM task_events")
def resource_bands(spark, sf_dir):
    return load(spark, sf_dir, "task_events").select("event_id", status.resource_band(F.col("progress")).alias("band"))


@query("task_events", sql="SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, state, count(*) AS n FROM task_events GROUP BY 1, 2")
def window_task_counts(spark, sf_dir):
    return progress.window_counts(load(spark, sf_dir, "task_events")).select(F.col("start").cast("timestamp_ntz").cast("string").alias("start"), "state", "n")


@query("task_events", sql="""
+ g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS k FROM g)
SELECT task_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, max(progress) AS top FROM s GROUP BY task_id, k""")
def task_sessions(spark, sf_dir):
    found = progress.sessions(load(spark, sf_dir, "task_events"))
    return found.select("task_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "top")


def _events_stream(spark, sf_dir):
    """The events table as a file stream, mapped like task_events, and a folder for what is made of it."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    base = scratch_path(spark, "events")
    table.write.parquet(f"{base}/in")
    rows = progress.read_stream(spark, f"{base}/in", table.schema)
    state = F.when(F.col("event_type").isin("view", "click"), "PROGRESS").when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("FAILURE")
    return rows.select("event_id", "ts", F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"), state.alias("state"), F.floor("value").cast("int").alias("progress")), base


def _run(spark, rows, base):
    progress.run_available(rows, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query("task_events", sql=_CHANGES)
def stream_progress_changes(spark, sf_dir):
    events, base = _events_stream(spark, sf_dir)
    progress.write_progress_changes(events, f"{base}/out", f"{base}/states", f"{base}/checkpoint")
    return spark.read.schema("task_id string, event_id bigint, progress int").parquet(f"{base}/out/*")


@query("task_events", sql="SELECT task_id, state, count(*) AS n, sum(event_id) AS ids FROM task_events GROUP BY 1, 2")
def stream_events_kept(spark, sf_dir):
    """Events that a stream writes as they come, counted by task and state: none is lost or doubled."""
    events, base = _events_stream(spark, sf_dir)
    kept = _run(spark, progress.timed(events).withWatermark("ts", progress.LATENESS).select("task_id", "state", "event_id"), base)
    return kept.groupBy("task_id", "state").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("task_events", sql="""
+ m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM task_events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, state, count(*) AS n FROM task_events GROUP BY 1, 2)
SELECT CAST(start AS VARCHAR) AS start, state, n FROM w, m WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_task_counts(spark, sf_dir):
    """Closed windows only: those that end an hour or more before the last event."""
    events, base = _events_stream(spark, sf_dir)
    return _run(spark, progress.window_counts(events), base).select(F.col("start").cast("timestamp_ntz").cast("string").alias("start"), "state", "n")
