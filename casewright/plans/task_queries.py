"""Queries over calls of a model, what tasks tell, and what is shown of hits, cases and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import display, timefmt
from casewright.operators import access, chunks, context, mutations, report, retrieval, status, tasks
from casewright.plans.case_queries import _DURATION, _HOURS
from casewright.plans.chunk_queries import _CONTEXT, _NAMES, _SCORED, _TEXT, WORDS, _names, _scored
from casewright.plans.registry import query
from casewright.sources import tables
from casewright.sources.relations import load
from casewright.sources.storage import materialize, scratch_path

NOW = "2001-02-03 04:05:06"


@query("chunks", sql=_SCORED + f""",
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) <= 10),
t AS (SELECT *, ({_TEXT}) + score / 10 AS again, row_number() OVER (PARTITION BY application_id ORDER BY ({_TEXT}) + score / 10 DESC, document_id, chunk_index) AS position FROM c QUALIFY position <= 3)
SELECT application_id, CAST(position AS INT) AS position, md5(text) AS text_md5, CAST(document_id AS VARCHAR) AS document_id, coalesce(n.name, 'Неизвестный документ') AS document_name, CAST(page_number AS VARCHAR) AS page, round(score, 4) AS score, 'vector' AS search_type, section, content_type, round(again, 4) AS rerank_score
FROM t LEFT JOIN ({_NAMES}) n ON n.id = document_id""")
def detailed_hits(spark, sf_dir):
    """Reranked hits as one case's search shows them, with their metadata and second score."""
    hits = retrieval.detailed(retrieval.rerank(_scored(spark, sf_dir), WORDS, 10, 3), _names(spark, sf_dir))
    return hits.select("application_id", "position", F.md5("text").alias("text_md5"), "document_id", "document_name", "page", "score", "search_type", "metadata.section", "metadata.content_type", "rerank_score")


@query("chunks", sql=_SCORED + _CONTEXT.replace("position <= 4", "position <= 8") + """,
r AS (SELECT application_id, length(context) AS n, CASE length(context) % 4 WHEN 0 THEN concat('Результат: ', length(context)) WHEN 1 THEN concat('{"value": "v', length(context), '"}') WHEN 2 THEN concat('возможно ', length(context)) END AS raw_response FROM k)
SELECT application_id, CASE n % 4 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN concat('v', n) WHEN 2 THEN concat('возможно ', n) END AS value, CAST(CASE n % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 END AS DOUBLE) AS confidence, raw_response FROM r""")
def answered_searches(spark, sf_dir):
    """The answer over the first eight of each case's twelve best hits, through the parser; every fourth call fails, by the length of its context."""
    names = _names(spark, sf_dir).select(F.col("document_id").alias("n_id"), F.col("name").alias("document_name"))
    hits = retrieval.top_k(_scored(spark, sf_dir), 12).join(names, F.col("document_id") == F.col("n_id"), "left")

    def respond(_, read):
        n, shown = F.length(read) % 4, F.length(read).cast("string")
        return F.when(n == 0, F.concat(F.lit("Результат: "), shown)).when(n == 1, F.concat(F.lit('{"value": "v'), shown, F.lit('"}'))).when(n == 2, F.concat(F.lit("возможно "), shown))

    questions = hits.select("application_id").distinct().withColumn("query", F.lit("q"))
    found = retrieval.answered(hits, questions, respond, context.MOST_IN_CONTEXT)
    return found.withColumn("confidence", F.round("confidence", 4))


_FILE_SECONDS = f"""
+ d AS (SELECT application_id, coalesce(sum(indexing_seconds), 0) AS ended, coalesce(sum(coalesce(indexing_seconds, date_diff('second', CAST(indexing_started_at AS TIMESTAMP), TIMESTAMP '{NOW}'))), 0) AS going FROM files GROUP BY 1)"""


def _timed_files(spark, sf_dir):
    files = load(spark, sf_dir, "files").withColumn("indexing_started_at", F.col("indexing_started_at").cast("timestamp_ntz"))
    return files.withColumn("indexing_completed_at", F.timestamp_add("SECOND", "indexing_seconds", "indexing_started_at"))


@query("files", sql=_FILE_SECONDS + " SELECT application_id, CAST(ended AS BIGINT) AS ended, CAST(going AS BIGINT) AS going FROM d")
def indexing_seconds(spark, sf_dir):
    """Seconds of each case's indexing, of what has ended and of what goes on now."""
    return status.indexing_seconds(_timed_files(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


_RAN = "CASE WHEN id % 3 <> 0 THEN CAST(id * 7 % 9000 AS BIGINT) END"


def _timed_cases(spark, sf_dir):
    i = F.col("id")
    apps = load(spark, sf_dir, "applications").withColumn("analysis_started_at", F.col("created_at").cast("timestamp_ntz"))
    end = F.timestamp_add("SECOND", F.when(i % 3 != 0, i * 7 % 9000).cast("int"), "analysis_started_at")
    return apps.withColumns({"analysis_completed_at": end, "status_message": F.when(i % 13 != 0, F.concat(F.lit("m"), i.cast("string")))})


@query("applications", sql=f"""
SELECT id, CASE WHEN analysis_completed_params > 0 THEN 'analyzed' ELSE 'indexed' END AS status, CASE WHEN analysis_completed_params > 0 THEN concat('Анализ остановлен пользователем. Обработано параметров: ', analysis_completed_params, ' из ', analysis_total_params) ELSE 'Анализ остановлен пользователем' END AS status_message,
  'analyzing' AS last_operation, strftime(coalesce(CAST(created_at AS TIMESTAMP) + to_seconds({_RAN}), TIMESTAMP '{NOW}'), '%Y-%m-%d %H:%M:%S') AS completed FROM applications""")
def stopped_cases(spark, sf_dir):
    """Stopped analyses and when they ended: those that had ended keep their time."""
    found = status.stopped_at(_timed_cases(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    return found.select("id", "status", "status_message", "last_operation", F.date_format("analysis_completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed"))


_SHOWN = lambda s: _DURATION.format(s=s, long=_HOURS.format(s=s))


@query("applications", "files", sql=_FILE_SECONDS + f""",
a AS (SELECT *, {_RAN} AS ran, coalesce({_RAN}, date_diff('second', CAST(created_at AS TIMESTAMP), TIMESTAMP '{NOW}')) AS runs FROM applications),
j AS (SELECT a.*, CAST(d.ended AS BIGINT) AS ended, CAST(d.going AS BIGINT) AS going FROM a LEFT JOIN d ON d.application_id = a.id)
SELECT id, CASE WHEN id % 13 <> 0 THEN concat('m', id, CASE WHEN status = 'indexed' AND ended > 0 THEN concat(' (', {_SHOWN('ended')}, ')') WHEN status = 'analyzed' AND ran IS NOT NULL THEN concat(' (', {_SHOWN('ran')}, ')')
  WHEN status = 'error' AND last_operation = 'indexing' AND going > 0 THEN concat(' (выполнялось ', {_SHOWN('going')}, ')') WHEN status = 'error' AND last_operation = 'analyzing' THEN concat(' (выполнялось ', {_SHOWN('runs')}, ')') ELSE '' END) END AS message FROM j""")
def status_messages(spark, sf_dir):
    """Status messages with how long their operation took or has been going on."""
    return status.status_messages(_timed_cases(spark, sf_dir), _timed_files(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@query("applications", sql="SELECT id, CASE id % 4 WHEN 2 THEN 'about it' WHEN 3 THEN name END AS description FROM applications")
def described_cases(spark, sf_dir):
    """New cases' descriptions: empty and blank ones are none."""
    i = F.col("id")
    told = F.when(i % 4 == 0, "").when(i % 4 == 1, "  ").when(i % 4 == 2, " about it ").otherwise(F.col("name"))
    apps = load(spark, sf_dir, "applications")
    forms = apps.select("id", "name", told.alias("description"), "user_id", F.array(F.lit(1).cast("bigint")).alias("checklist_ids"))
    return mutations.create_cases(forms, load(spark, sf_dir, "checklists"))[0].select("id", "description")


@query("task_events", sql="""
+ k AS (SELECT task_id, event_id, unnest(['state', 'progress', concat('k', event_id % 3)]) AS key, unnest([state, CAST(progress AS VARCHAR), CAST(event_id AS VARCHAR)]) AS value FROM task_events),
m AS (SELECT task_id, key, arg_max(value, event_id) AS value FROM k GROUP BY ALL), e AS (SELECT task_id FROM m WHERE key = 'state' AND value = 'SUCCESS'),
x AS (SELECT task_id, unnest(['progress', 'stage', 'message']) AS key, unnest(['100', 'complete', 'Задача успешно завершена']) AS value FROM e)
SELECT * FROM m UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.task_id = x.task_id AND m.key = x.key)""")
def merged_task_meta(spark, sf_dir):
    """What each task's events tell, the last one of a key winning; tasks that ended well tell the rest of their end."""
    events = load(spark, sf_dir, "task_events")
    told = F.create_map(F.lit("state"), "state", F.lit("progress"), F.col("progress").cast("string"), F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")), F.col("event_id").cast("string"))
    merged = tasks.merged_meta(events.select("task_id", F.col("event_id").alias("seq"), told.alias("meta")))
    meta = F.when(F.col("meta")["state"] == "SUCCESS", tasks.ended_meta(F.col("meta"))).otherwise(F.col("meta"))
    return merged.select("task_id", F.explode(meta))


_VALUE = "concat('{\"name\":\"', p.name, '\",\"value\":\"', r.value, '\",\"confidence\":', CAST(CAST(r.confidence AS DOUBLE) AS VARCHAR), '}')"


@query("application_checklists", "checklists", "checklist_parameters", "parameter_results", sql=f"""
+ k AS (SELECT checklist_id, count(*) AS total FROM checklist_parameters GROUP BY 1),
l AS (SELECT b.application_id, b.checklist_id, count(*) AS n, concat('[', string_agg({_VALUE}, ',' ORDER BY p.order_index, p.id), ']') AS parameters
  FROM parameter_results r JOIN checklist_parameters p ON p.id = r.parameter_id JOIN application_checklists b ON b.application_id = r.application_id AND b.checklist_id = p.checklist_id WHERE r.value IS NOT NULL GROUP BY 1, 2)
SELECT l.application_id, CAST(sum(n) AS BIGINT) AS n_results, md5(concat('[', string_agg(concat('{{"checklist_id":', l.checklist_id, ',"name":"', c.name, '","total":', total, ',"parameters":', parameters, '}}'), ',' ORDER BY l.checklist_id), ']')) AS report_md5
FROM l JOIN checklists c ON c.id = l.checklist_id JOIN k ON k.checklist_id = l.checklist_id GROUP BY 1""")
def case_reports(spark, sf_dir):
    """Every case's nested report of what has been found so far, by its digest."""
    links, results = (load(spark, sf_dir, t, by="l_orderkey") for t in ("application_checklists", "parameter_results"))
    found = report.nested_reports(links, load(spark, sf_dir, "checklists"), load(spark, sf_dir, "checklist_parameters"), results)
    return found.select("application_id", "n_results", F.md5("report").alias("report_md5"))


def deterministic_send(model: str, prompt: str, attempt: int) -> tuple[str, int]:
    """A stand-in for a model's service: by the length of the prompt it never answers, answers the third time, or answers."""
    if len(prompt) % 7 == 0 or (len(prompt) % 7 == 1 and attempt < 3):
        raise TimeoutError("no answer")
    return prompt.upper()[:20], len(prompt) // 4


@query("checklist_parameters", sql="""
+ q AS (SELECT id, llm_model, search_query AS s, length(search_query) % 7 AS k FROM checklist_parameters)
SELECT id AS request, llm_model AS model, CASE WHEN k > 0 THEN upper(left(s, 20)) END AS response, CASE WHEN k > 0 THEN CAST(length(s) // 4 AS BIGINT) END AS tokens, CASE WHEN k = 0 THEN 'TimeoutError: no answer' END AS reason, CAST(CASE WHEN k < 2 THEN 3 ELSE 1 END AS INT) AS tries FROM q""")
def called_models(spark, sf_dir):
    """Every parameter's query sent to its model; calls that fail are rows with the reason."""
    requests = load(spark, sf_dir, "checklist_parameters").select(F.col("id").alias("request"), F.col("llm_model").alias("model"), F.col("search_query").alias("prompt"))
    return tasks.call_model(requests, deterministic_send)


@query("checklist_parameters", sql="SELECT id, upper(left(search_query, 20)) AS value FROM checklist_parameters")
def analysis_in_parts(spark, sf_dir):
    """An analysis that is made part by part, so that it can be stopped and gone on with."""
    jobs = load(spark, sf_dir, "checklist_parameters")
    return tasks.run_in_parts(jobs, lambda df: df.select("id", F.upper(F.left("search_query", F.lit(20))).alias("value")), scratch_path(spark, "parts"), ["id"], parts=4)


@query("checklists", sql="""
SELECT id, name, CASE WHEN id % 2 = 1 THEN user_id END AS user_id, CASE WHEN id % 2 = 1 THEN is_public ELSE false END AS is_public FROM checklists
UNION ALL SELECT n, concat(kind, ':', name), NULL, NULL FROM (VALUES (-1, 'bigint', 'id'), (-2, 'string', 'name'), (-3, 'bigint', 'user_id'), (-4, 'boolean', 'is_public')) v(n, kind, name)""")
def migrated_table(spark, sf_dir):
    """A table of checklists that is given an owner and a flag: older rows read the defaults, a second migration changes nothing; and its columns as the catalogue tells them."""
    lists, path = load(spark, sf_dir, "checklists"), scratch_path(spark, "table")
    table = f"checklists_{path[-32:]}"
    tables.create_table(lists.where("id % 2 = 0").select("id", "name"), table, path)
    for _ in range(2):
        tables.add_missing_columns(spark, table, {"user_id": ("BIGINT", None), "is_public": ("BOOLEAN", "false")})
    lists.where("id % 2 = 1").select("id", "name", "user_id", "is_public").write.insertInto(table)
    columns = [(-n, f"{kind}:{name}") for n, (name, kind) in enumerate(tables.columns_of(spark, table).items(), 1)]
    told = spark.createDataFrame(columns, "id bigint, name string").selectExpr("id", "name", "CAST(NULL AS BIGINT) AS user_id", "CAST(NULL AS BOOLEAN) AS is_public")
    found = materialize(spark.table(table).select("id", "name", "user_id", "is_public"), "migrated")
    spark.sql(f"DROP TABLE {table}")
    return found.unionByName(told)


@query("chunks", sql="SELECT document_id, chunk_index, md5(CASE WHEN chunk_index % 5 = 1 THEN '' ELSE text END) AS text_md5, CASE WHEN chunk_index % 7 <> 2 THEN content_length END AS content_length, CASE WHEN chunk_index % 7 <> 2 THEN section END AS section FROM chunks")
def chunk_fields(spark, sf_dir):
    """Texts and metadata of chunks as the index returns them, some without a text and some without metadata."""
    i = F.col("chunk_index")
    chunk = F.struct(F.when(i % 5 != 1, F.col("text")).alias("text"), F.when(i % 7 != 2, F.struct("content_length", "section")).alias("metadata"))
    rows = load(spark, sf_dir, "chunks").select("document_id", "chunk_index", chunk.alias("chunk"))
    return rows.select("document_id", "chunk_index", F.md5(chunks.chunk_text(F.col("chunk"))).alias("text_md5"), *chunks.chunk_metadata(F.col("chunk"), "content_length", "section"))


@query("applications", sql="""
SELECT id FROM (SELECT id FROM applications WHERE id % 3 = 0 UNION ALL SELECT -id FROM applications WHERE id % 100 = 1) WHERE id NOT IN (SELECT id FROM applications WHERE user_id = 7)""")
def rejected_requests(spark, sf_dir):
    """Of the cases that a user asks for, those that are unknown or that they may not use."""
    apps, i = load(spark, sf_dir, "applications"), F.col("id")
    asked = apps.where(i % 3 == 0).select("id").unionAll(apps.where(i % 100 == 1).select((-i).alias("id")))
    return access.rejected_cases(asked, apps, "user", 7)


@query("applications", sql="""
SELECT id, concat('a<br>', name, '<br>b') AS shown, concat(id, ',', id + 1) AS ids, CASE WHEN id % 4 = 0 THEN '' ELSE strftime(created_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Moscow', '%Y-%m-%d %H:%M') || ' MSK' END AS moment FROM applications""")
def shown_values(spark, sf_dir):
    """Line breaks, lists of ids and times with their zone as the interface shows them."""
    i = F.col("id")
    listed = F.concat(i.cast("string"), F.lit(", x,"), (i + 1).cast("string"), F.lit(" ,,3a"))
    moment = timefmt.shown(timefmt.moscow(F.when(i % 4 != 0, F.col("created_at"))), "yyyy-MM-dd HH:mm", "MSK")
    return load(spark, sf_dir, "applications").select("id", display.line_breaks(F.concat(F.lit("a\n"), "name", F.lit("\nb"))).alias("shown"), F.array_join(display.id_list(listed).cast("array<string>"), ",").alias("ids"), moment.alias("moment"))


@query("users", sql="""
+ n AS (SELECT count(*) AS n FROM users WHERE role = 'admin' AND id % 50 <> 0), s AS (SELECT * FROM (VALUES ('checklists', 1, 'base'), ('parameters', 1, 'parameter 1'), ('parameters', 2, 'parameter 2'), ('parameters', 3, 'parameter 3'), ('users', 1, 'admin')) v(relation, id, name))
SELECT 'without an admin' AS installation, relation, CAST(s.id AS BIGINT) AS id, name FROM s, n WHERE n = 0 UNION ALL SELECT 'whole', relation, CAST(s.id AS BIGINT), name FROM s WHERE NOT EXISTS (SELECT 1 FROM users WHERE role = 'admin')""")
def seeded(spark, sf_dir):
    """What a new installation is given: everything where no user is an admin, nothing where one is."""
    users, out = load(spark, sf_dir, "users"), None
    for name, of in (("without an admin", users.where("id % 50 <> 0")), ("whole", users)):
        for relation, rows in mutations.seed(spark, of).items():
            one = rows.select(F.lit(name).alias("installation"), F.lit(relation).alias("relation"), "id", F.col("username" if relation == "users" else "name").alias("name"))
            out = one if out is None else out.unionAll(one)
    return out
