"""Queries over edits of cases, files, checklists and users, and over what the interface shows of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import answers, display
from casewright.operators import access, catalog, chunks, context, extraction, mutations, report, retrieval, status
from casewright.plans.registry import query
from casewright.sources.relations import load

_OWN = "EXISTS (SELECT 1 FROM checklist_parameters p JOIN application_checklists b USING (checklist_id) WHERE p.id = {r}.parameter_id AND b.application_id = {r}.application_id)"


@query("stored_results", sql="""
+ f AS (SELECT *, row_number() OVER (PARTITION BY application_id, parameter_id ORDER BY id) AS rn FROM stored_results)
SELECT application_id, parameter_id, id, value, CAST(confidence AS DOUBLE) AS confidence FROM f WHERE rn = 1""")
def first_results(spark, sf_dir):
    found = report.first_results(load(spark, sf_dir, "stored_results"))
    return found.select("application_id", "parameter_id", "id", "value", F.col("confidence").cast("double").alias("confidence"))


@query("stored_results", "checklist_parameters", "application_checklists", sql=f"""
+ r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id, parameter_id ORDER BY id) AS rn FROM stored_results) WHERE rn = 1),
n AS (SELECT application_id, parameter_id + application_id % 2 AS parameter_id, id + 7 AS seq, concat('new ', value) AS value, confidence / 2 AS confidence FROM stored_results WHERE confidence > 0.05),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id, parameter_id ORDER BY seq DESC) AS rn FROM n WHERE {_OWN.format(r="n")}) WHERE rn = 1)
SELECT r.id, coalesce(r.application_id, k.application_id) AS application_id, coalesce(r.parameter_id, k.parameter_id) AS parameter_id, coalesce(k.value, r.value) AS value,
  CAST(round(coalesce(k.confidence, r.confidence), 6) AS DOUBLE) AS confidence, strftime(r.created_at, '%Y-%m-%d') AS created
FROM r FULL JOIN k ON r.application_id = k.application_id AND r.parameter_id = k.parameter_id""")
def upsert_results(spark, sf_dir):
    """Changes repeat keys; stored rows keep their id and time, new ones have none yet."""
    rows = load(spark, sf_dir, "stored_results")
    changes = rows.where("confidence > 0.05").select("application_id", (F.col("parameter_id") + F.col("application_id") % 2).alias("parameter_id"), (F.col("id") + 7).alias("seq"), F.concat(F.lit("new "), "value").alias("value"), (F.col("confidence") / 2).alias("confidence"))
    done = mutations.upsert_results(report.first_results(rows), changes, load(spark, sf_dir, "checklist_parameters"), load(spark, sf_dir, "application_checklists"), order=("seq",))
    return done.select("id", "application_id", "parameter_id", "value", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("applications", "checklist_parameters", "application_checklists", sql="""
+ t AS (SELECT application_id, count(*) AS n FROM application_checklists JOIN checklist_parameters USING (checklist_id) GROUP BY 1)
SELECT id, CASE WHEN status = 'indexed' THEN 'analyzing' ELSE status END AS status, CAST(CASE WHEN status = 'indexed' THEN coalesce(n, 0) ELSE analysis_total_params END AS INT) AS analysis_total_params,
  CASE WHEN status = 'indexed' THEN 0 ELSE analysis_completed_params END AS analysis_completed_params FROM applications LEFT JOIN t ON application_id = id""")
def started_analyses(spark, sf_dir):
    apps = load(spark, sf_dir, "applications")
    return mutations.start_analysis(apps, apps.where("status = 'indexed'").select("id"), load(spark, sf_dir, "checklist_parameters"), load(spark, sf_dir, "application_checklists"))


@query("applications", "files", sql="""
+ f AS (SELECT * FROM files WHERE id % 5 <> 0), c AS (SELECT application_id, count(*) AS total, count(*) FILTER (indexing_status = 'indexing') AS indexing, count(*) FILTER (indexing_status = 'completed') AS completed, count(*) FILTER (indexing_status = 'error') AS error FROM f GROUP BY 1)
SELECT id, CASE WHEN total IS NULL THEN 'created' WHEN completed = total THEN 'indexed' WHEN error > 0 AND completed > 0 THEN 'indexed' WHEN error > 0 THEN 'error' WHEN indexing > 0 THEN 'indexing' ELSE 'created' END AS status FROM applications LEFT JOIN c ON application_id = id""")
def deleted_files(spark, sf_dir):
    """Every fifth file goes; the states of the cases that follow."""
    files = load(spark, sf_dir, "files")
    left, _ = mutations.delete_files(files, files.select(F.col("id").alias("document_id")), files.where("id % 5 = 0").select("id"))
    return status.reduce_web(load(spark, sf_dir, "applications"), left).select("id", "status")


@query("chunks", sql="SELECT application_id, content_type, count(*) AS n FROM chunks WHERE document_id % 4 <> 0 GROUP BY 1, 2")
def deleted_chunks(spark, sf_dir):
    rows = load(spark, sf_dir, "chunks")
    gone = rows.where("document_id % 4 = 0").select(F.col("document_id").alias("id")).distinct()
    return chunks.index_stats(mutations.delete_files(gone, rows, gone)[1])


@query("files", sql="""
SELECT id, CASE WHEN id % 3 = 0 THEN 'indexing' ELSE indexing_status END AS indexing_status, CASE WHEN id % 3 <> 0 THEN error_message END AS error_message, CASE WHEN id % 3 = 0 THEN 0 ELSE chunks_count END AS chunks_count,
  CASE WHEN id % 3 <> 0 THEN strftime(indexing_started_at, '%Y-%m-%d') END AS started FROM files""")
def reset_files(spark, sf_dir):
    files = load(spark, sf_dir, "files")
    done = mutations.reset_for_indexing(files, files.where("id % 3 = 0").select("id"))
    return done.select("id", "indexing_status", "error_message", "chunks_count", F.date_format("indexing_started_at", "yyyy-MM-dd").alias("started"))


@query("files", sql="""
SELECT id, CASE id % 4 WHEN 0 THEN 'indexing' WHEN 1 THEN 'completed' WHEN 2 THEN 'error' ELSE indexing_status END AS indexing_status, CASE id % 4 WHEN 0 THEN NULL WHEN 2 THEN 'broken' ELSE error_message END AS error_message,
  CASE id % 4 WHEN 1 THEN 42 ELSE chunks_count END AS chunks_count, CASE WHEN id % 4 IN (1, 2) THEN '2001-02-03' END AS ended FROM files""")
def file_lifecycle(spark, sf_dir):
    """Every file has a start, then a quarter of them each end well, end in error, or have no event at all."""
    files = load(spark, sf_dir, "files").withColumn("indexing_completed_at", F.lit(None).cast("timestamp_ntz"))
    at = F.lit("2001-02-03").cast("timestamp_ntz")
    event = lambda seq, kind: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(42).alias("chunks"), F.lit("broken").alias("message"), at.alias("at"))
    events = files.where("id % 4 <> 3").select(F.col("id").alias("file_id"), F.explode(F.when(F.col("id") % 4 == 0, F.array(event(1, "start"))).when(F.col("id") % 4 == 1, F.array(event(1, "start"), event(2, "done"))).otherwise(F.array(event(1, "start"), event(2, "failed")))).alias("e")).select("file_id", "e.*")
    return mutations.lifecycle(files, events).select("id", "indexing_status", "error_message", "chunks_count", F.date_format("indexing_completed_at", "yyyy-MM-dd").alias("ended"))


@query("application_checklists", "checklist_parameters", "parameter_results", sql="""
+ g AS (SELECT * FROM application_checklists WHERE (application_id + checklist_id) % 3 = 0)
SELECT 'links' AS relation, application_id, count(*) AS n, sum(checklist_id) AS ids FROM application_checklists WHERE (application_id + checklist_id) % 3 <> 0 GROUP BY 2 UNION ALL
SELECT 'results', application_id, count(*), sum(r.parameter_id) FROM parameter_results r WHERE NOT EXISTS (SELECT 1 FROM g JOIN checklist_parameters p USING (checklist_id) WHERE g.application_id = r.application_id AND p.id = r.parameter_id) GROUP BY 2""")
def removed_checklists(spark, sf_dir):
    links, results = load(spark, sf_dir, "application_checklists"), load(spark, sf_dir, "parameter_results")
    links_left, results_left = mutations.remove_checklists(links, results, load(spark, sf_dir, "checklist_parameters"), links.where("(application_id + checklist_id) % 3 = 0"))
    count = lambda df, name, c: df.groupBy("application_id").agg(F.count("*").alias("n"), F.sum(c).alias("ids")).select(F.lit(name).alias("relation"), "application_id", "n", "ids")
    return count(links_left, "links", "checklist_id").unionAll(count(results_left, "results", "parameter_id"))


@query("applications", sql=f"SELECT id, CASE WHEN status = 'analyzed' AND id % 3 = 0 THEN 'indexed' ELSE status END AS status, CASE WHEN status = 'analyzed' AND id % 3 = 0 THEN '{mutations.REMOVED}' END AS status_message FROM applications")
def cases_to_analyze_again(spark, sf_dir):
    apps = load(spark, sf_dir, "applications")
    return mutations.back_to_indexed(apps, apps.where("id % 3 = 0").select(F.col("id").alias("application_id")), mutations.REMOVED)


@query("checklist_parameters", "checklists", sql="""
SELECT p.id + 1000000000000 AS id, p.checklist_id + 1000000000000 AS checklist_id, c.name || ' (копия)' AS checklist, p.name, p.search_query, p.llm_query, p.order_index, p.use_full_scan, p.use_reranker, p.search_limit, p.llm_model, 6 AS user_id, false AS is_public
FROM checklist_parameters p JOIN checklists c ON c.id = p.checklist_id WHERE c.id % 3 = 0""")
def cloned_checklists(spark, sf_dir):
    lists = load(spark, sf_dir, "checklists").where("id % 3 = 0")
    copies, parameters = mutations.clone_checklists(lists, load(spark, sf_dir, "checklist_parameters"), 6, 10**12)
    heads = copies.select(F.col("id").alias("checklist_id"), F.col("name").alias("checklist"), "user_id", "is_public")
    return parameters.join(heads, "checklist_id").select("id", "checklist_id", "checklist", "name", "search_query", "llm_query", "order_index", "use_full_scan", "use_reranker", "search_limit", "llm_model", "user_id", "is_public")


@query("applications", "checklists", sql="""
SELECT a.id, a.name, count(c.id) AS n, coalesce(sum(c.id), 0) AS ids FROM applications a
  JOIN (SELECT DISTINCT id, checklist_id FROM (SELECT id, id % 500 + 1 AS checklist_id FROM applications UNION ALL SELECT id, id % 7 + 1 FROM applications)) w ON w.id = a.id LEFT JOIN checklists c ON c.id = w.checklist_id WHERE a.id % 4 <> 0 GROUP BY 1, 2""")
def created_cases(spark, sf_dir):
    i = F.col("id")
    ids = F.when(i % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 500 + 1, i % 7 + 1, i % 7 + 1))
    forms = load(spark, sf_dir, "applications").select("id", "name", F.lit(None).cast("string").alias("description"), "user_id", ids.alias("checklist_ids"))
    cases, links = mutations.create_cases(forms, load(spark, sf_dir, "checklists"))
    per = links.groupBy(F.col("application_id").alias("l")).agg(F.count("*").alias("n"), F.sum("checklist_id").alias("ids"))
    return cases.join(per, F.col("id") == F.col("l"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit(0)).alias("ids"))


@query("applications", sql="""
+ a AS (SELECT id, name FROM applications), e AS (SELECT id, CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN name WHEN 2 THEN concat(' new ', id, ' ') ELSE 'case 1-URGENT 7' END AS name FROM a WHERE id % 5 <> 0),
t AS (SELECT a.id, a.name, trim(e.name) AS wanted FROM a LEFT JOIN e USING (id)),
k AS (SELECT *, CASE WHEN wanted = '' THEN 'name required' WHEN wanted <> name AND EXISTS (SELECT 1 FROM a o WHERE o.name = wanted AND o.id <> t.id) THEN 'name taken' END AS error FROM t)
SELECT id, CASE WHEN wanted IS NOT NULL AND error IS NULL THEN wanted ELSE name END AS name, error FROM k""")
def edited_cases(spark, sf_dir):
    apps, i = load(spark, sf_dir, "applications"), F.col("id")
    name = F.when(i % 4 == 0, "  ").when(i % 4 == 1, F.col("name")).when(i % 4 == 2, F.concat(F.lit(" new "), i.cast("string"), F.lit(" "))).otherwise("case 1-URGENT 7")
    return mutations.edit_cases(apps, apps.where("id % 5 <> 0").select("id", name.alias("name")))


@query("checklist_parameters", "checklists", sql="""
+ n AS (SELECT c.id, coalesce(max(order_index) + 1, 0) AS k FROM checklists c LEFT JOIN checklist_parameters p ON p.checklist_id = c.id GROUP BY 1)
SELECT checklist_id, p.id AS seq, name, '' AS description, search_query, CASE WHEN order_index % 2 = 0 THEN nullif(trim(llm_query), '') END AS llm_query, CAST(k + row_number() OVER (PARTITION BY checklist_id ORDER BY p.id) - 1 AS INT) AS order_index,
  CASE WHEN order_index % 3 = 0 THEN 3 ELSE search_limit END AS search_limit, use_reranker, 10 AS rerank_limit, use_full_scan, CAST(CASE WHEN order_index % 4 = 0 THEN 0.7 ELSE 0.1 END AS DOUBLE) AS temperature, 1000 AS max_tokens
FROM checklist_parameters p JOIN n ON n.id = p.checklist_id""")
def parameters_from_forms(spark, sf_dir):
    p, i = load(spark, sf_dir, "checklist_parameters"), F.col("order_index")
    tick = lambda c: F.when(F.col(c), "on").alias(c)
    forms = p.select("checklist_id", F.col("id").alias("seq"), "name", F.lit(None).cast("string").alias("description"), "search_query", (i % 2 == 0).cast("string").alias("use_separate"), "llm_query", F.when(i % 3 == 0, F.lit("")).otherwise(F.col("search_limit").cast("string")).alias("search_limit"), tick("use_reranker"), F.lit(None).cast("string").alias("rerank_limit"), tick("use_full_scan"), F.when(i % 4 == 0, "0.7").alias("temperature"), F.lit("x").alias("max_tokens"))
    return mutations.parameters_from_forms(forms, catalog.next_order_index(load(spark, sf_dir, "checklists"), p))


@query("applications", "users", sql="SELECT a.id, CASE WHEN a.id % 6 = 0 AND u.id IS NOT NULL THEN u.id ELSE a.user_id END AS user_id FROM applications a LEFT JOIN users u ON u.id = a.id % 3000")
def changed_owners(spark, sf_dir):
    apps = load(spark, sf_dir, "applications")
    return mutations.change_owners(apps, apps.where("id % 6 = 0").select("id", (F.col("id") % 3000).alias("owner")), load(spark, sf_dir, "users"))


@query("users", sql="SELECT id, CASE WHEN id = 50 THEN 'self' WHEN role = 'admin' AND (SELECT count(*) FROM users WHERE role = 'admin') <= 1 THEN 'last admin' END AS error FROM users")
def user_deletions(spark, sf_dir):
    return mutations.deletion_errors(load(spark, sf_dir, "users"), 50)


@query("applications", sql="SELECT id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INT) AS place FROM applications")
def cases_newest_first(spark, sf_dir):
    """Each owner's list of cases, in order."""
    return catalog.newest_first(load(spark, sf_dir, "applications"), ["user_id"]).select("id", "user_id", "place")


@query("users", "checklist_parameters", sql="""
SELECT 'users' AS relation, role AS grouped, id, CAST(row_number() OVER (PARTITION BY role ORDER BY username, id) AS INT) AS place FROM users UNION ALL
SELECT 'parameters', CAST(checklist_id AS VARCHAR), id, CAST(row_number() OVER (PARTITION BY checklist_id ORDER BY order_index, id) AS INT) FROM checklist_parameters""")
def lists_in_order(spark, sf_dir):
    users = catalog.placed(load(spark, sf_dir, "users"), ["role"], "username").select(F.lit("users").alias("relation"), F.col("role").alias("grouped"), "id", "place")
    parameters = catalog.placed(load(spark, sf_dir, "checklist_parameters"), ["checklist_id"], "order_index")
    return users.unionAll(parameters.select(F.lit("parameters"), F.col("checklist_id").cast("string"), "id", "place"))


@query("checklists", sql=f"""
SELECT id, user_id = 6 OR is_public AS may_see, user_id = 6 AND id % 2 = 0 AS published, false AS published_new FROM checklists""")
def checklist_access(spark, sf_dir):
    """What user 6, who isn't elevated, sees, and what is stored of a wish to publish on editing and on creating."""
    wish = F.col("id") % 2 == 0
    return load(spark, sf_dir, "checklists").select("id", access.may_see_checklist("user", 6, F.col("user_id"), F.col("is_public")).alias("may_see"), access.publishable("user", 6, wish, F.col("user_id"), creating=False).alias("published"), access.publishable("user", 6, wish, F.col("user_id"), creating=True).alias("published_new"))


@query("users", sql="""
SELECT id, CASE role WHEN 'admin' THEN 6 WHEN 'prompt_engineer' THEN 5 ELSE 4 END AS n_permissions, CASE role WHEN 'admin' THEN 'Полный доступ ко всем функциям системы' WHEN 'prompt_engineer' THEN 'Полный доступ ко всем функциям системы (кроме управления пользователями)' ELSE 'Создание и редактирование своих чек-листов' END AS first_permission,
  CASE role WHEN 'admin' THEN '' WHEN 'prompt_engineer' THEN 'Управление пользователями' ELSE 'Редактирование чужих чек-листов;Просмотр чужих заявок;Управление пользователями;Управление LLM моделями' END AS restrictions, role = 'admin' AS may_manage_users, role <> 'user' AS may_manage_models FROM users""")
def role_permissions(spark, sf_dir):
    role = F.col("role")
    permissions = access.permissions(role)
    return load(spark, sf_dir, "users").select("id", F.size(permissions).alias("n_permissions"), permissions[0].alias("first_permission"), F.array_join(access.restrictions(role), ";").alias("restrictions"), access.has_role(role, "admin").alias("may_manage_users"), access.has_role(role, *access.ELEVATED).alias("may_manage_models"))


@query("chunks", sql="SELECT document_id, chunk_index, content_type, text FROM chunks WHERE application_id = 3 ORDER BY document_id, chunk_index LIMIT 1000")
def chunk_page(spark, sf_dir):
    """The viewer's page of a case: its first 1000 chunks."""
    return chunks.page(load(spark, sf_dir, "chunks"), 3).select("document_id", "chunk_index", "content_type", "text")


@query("chunks", sql="SELECT doc_id AS document_id, coalesce(n, 0) AS n_chunks FROM documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks WHERE content_length > 0 GROUP BY 1) ON document_id = doc_id")
def chunks_per_document(spark, sf_dir):
    """0 for documents without a usable chunk."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    return chunks.count_per_document(documents, chunks.usable(load(spark, sf_dir, "chunks")))


@query("chunks", sql="""
+ s AS (SELECT application_id, content_type, count(*) AS n FROM chunks GROUP BY 1, 2)
SELECT application_id, '{"total_points":' || sum(n) || ',"content_types":{' || string_agg('"' || content_type || '":' || n, ',' ORDER BY content_type) || '}}' AS response FROM s GROUP BY 1""")
def index_report(spark, sf_dir):
    """The index's figures of each case as the interface answers them, in JSON."""
    found = chunks.index_stats_map(load(spark, sf_dir, "chunks"))
    return found.select("application_id", F.to_json(F.struct("total_points", "content_types")).alias("response"))


@query("chunks", sql="""
SELECT document_id, chunk_index, '[Источник: Документ ID: ' || document_id || CASE WHEN (document_id + chunk_index) % 3 = 0 THEN ', Страница: ' || page_number WHEN (document_id + chunk_index) % 3 = 1 THEN ', Страницы: ' || page_number || ', ' || (page_number + 1) ELSE '' END
  || CASE WHEN chunk_index % 2 = 0 THEN ', Чанк: ' || chunk_index ELSE ', Чанк: c' || chunk_index END || ']' || chr(10) || text || chr(10) AS block FROM chunks""")
def single_chunk_contexts(spark, sf_dir):
    kind, i = (F.col("document_id") + F.col("chunk_index")) % 3, F.col("chunk_index")
    page, pages = F.when(kind == 0, F.col("page_number")), F.when(kind == 1, F.array(F.col("page_number"), F.col("page_number") + 1))
    block = context.single_chunk(F.lit(None).cast("string"), F.col("document_id"), page, pages, F.when(i % 2 == 0, i), F.concat(F.lit("c"), i.cast("string")), F.col("text"))
    return load(spark, sf_dir, "chunks").select("document_id", "chunk_index", block.alias("block"))


@query("checklist_parameters", sql="SELECT id, CASE WHEN use_reranker AND length(search_query) < 20 THEN 'hybrid' ELSE 'vector' END AS method FROM checklist_parameters")
def search_methods(spark, sf_dir):
    return load(spark, sf_dir, "checklist_parameters").select("id", retrieval.search_method(F.col("search_query"), F.col("use_reranker"), retrieval.HYBRID_THRESHOLD).alias("method"))


_ENVELOPE = """'{"status":"success","count":' || n || ',"search_method":"vector","use_llm":' || CASE WHEN n > 0 THEN 'true' ELSE 'false' END || ',"execution_time":1.23,"application_ids":[1,2,3],"multi_search":true}'"""


@query("chunks", sql=f"""
+ s AS (SELECT application_id, count(*) AS total FROM chunks WHERE application_id IN (1, 2, 3) GROUP BY 1), h AS (SELECT application_id, least(total, 12) AS n, CAST(30 // 3 AS INT) AS rerank_limit FROM s)
SELECT application_id, {_ENVELOPE} AS response, least(n, 8) AS in_context, rerank_limit FROM h""")
def search_envelopes(spark, sf_dir):
    """A search over three cases, twelve hits each: its answer in JSON, how many hits the model reads, and each case's share of the rerank limit."""
    rows = load(spark, sf_dir, "chunks").where(F.col("application_id").isin(1, 2, 3)).withColumn("score", F.lit(0.5))
    hits = retrieval.top_k(rows, 12)
    per = hits.groupBy("application_id").agg(F.count("*").alias("n"), F.count_if(F.col("position") <= context.MOST_IN_CONTEXT).alias("in_context"))
    answer = retrieval.envelope(F.col("n"), F.lit("vector"), F.col("n") > 0, F.lit(1.2345), [1, 2, 3])
    return per.select("application_id", answer.alias("response"), "in_context", F.lit(retrieval.rerank_share(30, 3)).alias("rerank_limit"))


@query("chunks", sql="""
+ f AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY document_id, chunk_index) AS place FROM chunks WHERE application_id IN (5, 3)),
t AS (SELECT *, CASE application_id WHEN 5 THEN 0 ELSE 1 END AS turn FROM f WHERE place <= 4)
SELECT application_id, CAST(place AS INT) AS position, CAST(row_number() OVER (ORDER BY turn, place) AS INT) AS global_position, CAST(document_id AS VARCHAR) AS document_id, 'Неизвестный документ' AS document_name, CAST(page_number AS VARCHAR) AS page, 0.3333 AS score FROM t""")
def multi_app_shaped(spark, sf_dir):
    """Hits of two cases in request order; positions begin anew with each case."""
    hits = retrieval.across_cases(load(spark, sf_dir, "chunks").withColumn("score", F.lit(1 / 3)), [5, 3], 4)
    names = spark.createDataFrame([], "document_id bigint, name string")
    return retrieval.shaped(hits, names, "global_position").select("application_id", "position", "global_position", "document_id", "document_name", "page", "score")


@query("chunks", sql="""
+ f AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY document_id, chunk_index) AS place FROM chunks), c AS (SELECT application_id, string_agg(lower(text), ' ' ORDER BY place) AS t FROM f WHERE place <= 8 GROUP BY 1)
SELECT application_id, contains(t, 'and') AS found, CASE WHEN contains(t, 'and') THEN 'and' ELSE 'Информация не найдена' END AS value FROM c""")
def search_answers(spark, sf_dir):
    """The stand-in model's answer over the first eight hits of each case."""
    hits = retrieval.top_k(load(spark, sf_dir, "chunks").withColumns({"score": F.lit(0.5), "document_name": F.lit(None).cast("string")}), context.MOST_IN_CONTEXT)
    read = hits.groupBy("application_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", F.lower("text").alias("t")))), lambda x: x["t"]), " ").alias("t"))
    found = F.contains("t", F.lit("and"))
    return read.select("application_id", found.alias("found"), F.when(found, "and").otherwise(answers.NOT_FOUND).alias("value"))


@query(sql="""
WITH m AS (SELECT DISTINCT p_brand AS name, CAST(substr(p_brand, 7, 1) AS INT) AS k FROM part), a AS (SELECT * FROM m UNION ALL SELECT 'bge-m3:latest', 9)
SELECT name, CASE WHEN k % 3 = 0 THEN 4096 WHEN k % 3 = 1 THEN 2048 ELSE 8192 END AS context_length, CASE WHEN k % 3 = 0 THEN concat(k, 'B') ELSE 'Неизвестно' END AS parameter_size, CASE WHEN k % 3 = 1 THEN 'f' || k ELSE 'Неизвестно' END AS family FROM a WHERE name <> 'bge-m3:latest'""")
def model_list(spark, sf_dir):
    """Models but the embedding one; what the index tells of them, else their own details, else constants."""
    named = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("name"), F.substring("p_brand", 7, 1).cast("int").alias("k")).distinct()
    models = named.unionAll(spark.createDataFrame([("bge-m3:latest", 9)], "name string, k int"))
    info = models.where("k % 3 = 0").select("name", F.lit(4096).alias("context_length"), F.concat(F.col("k").cast("string"), F.lit("B")).alias("parameter_size"), F.lit(None).cast("string").alias("family"))
    details = models.where("k % 3 <= 1").select("name", F.lit(2048).alias("context_length"), F.lit(None).cast("string").alias("parameter_size"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("family"))
    return catalog.model_info(catalog.usable_models(models), info, details)


@query("applications", "task_events", "files", sql="""
+ t AS (SELECT task_id, arg_max(state, (ts, event_id)) AS state, arg_max(progress, (ts, event_id)) AS progress FROM task_events GROUP BY 1),
f AS (SELECT application_id, true AS failed, arg_min(error_message, id) AS message FROM files WHERE indexing_status = 'error' GROUP BY 1),
j AS (SELECT a.*, t.state, t.progress AS worker, f.failed, f.message, CASE WHEN analysis_total_params = 0 THEN 0 ELSE CAST(trunc(CAST(analysis_completed_params AS DOUBLE) / analysis_total_params * 100) AS INT) END AS done FROM applications a LEFT JOIN t ON t.task_id = concat('task-', a.id % 200) LEFT JOIN f ON f.application_id = a.id)
SELECT id, CASE WHEN status = 'indexing' AND failed THEN 'error' WHEN status = 'analyzing' THEN 'progress' WHEN status = 'error' THEN 'error' WHEN state = 'PENDING' THEN 'pending' WHEN state = 'PROGRESS' THEN 'progress' WHEN state = 'SUCCESS' THEN 'success' WHEN state = 'FAILURE' THEN 'error' ELSE status END AS response,
  CASE WHEN status = 'indexing' AND failed THEN 0 WHEN status = 'analyzing' THEN CASE WHEN state = 'PROGRESS' AND worker <> 0 THEN worker ELSE done END WHEN status = 'error' THEN 0 WHEN state = 'PENDING' THEN 0 WHEN state = 'PROGRESS' THEN worker WHEN state = 'SUCCESS' THEN 100 WHEN state = 'FAILURE' THEN NULL WHEN status IN ('indexed', 'analyzed') THEN 100 ELSE 0 END AS progress,
  CASE WHEN status = 'indexing' AND failed THEN message END AS message FROM j""")
def application_responses(spark, sf_dir):
    apps = load(spark, sf_dir, "applications").withColumn("task_id", F.concat(F.lit("task-"), (F.col("id") % 200).cast("string")))
    return status.application_responses(apps, status.latest_states(load(spark, sf_dir, "task_events")), load(spark, sf_dir, "files"))


@query("task_events", sql="""
+ m AS (SELECT max(ts) AS now FROM task_events), l AS (SELECT task_id, arg_max(state, (ts, event_id)) AS state, min(ts) AS began, max(ts) AS last FROM task_events GROUP BY 1)
SELECT task_id, state IN ('PENDING', 'PROGRESS') AND date_diff('microsecond', began, now) > 7200000000 AS timed_out, state NOT IN ('PENDING', 'PROGRESS') AND date_diff('microsecond', last, now) > 3600000000 AS expired FROM l, m""")
def task_deadlines(spark, sf_dir):
    """At the time of the last event: polls given up after two hours, results that have expired after one."""
    events = load(spark, sf_dir, "task_events")
    return status.deadlines(events, events.agg(F.max("ts")).first()[0])


@query("applications", sql="""
SELECT id, 5 + CAST(trunc(CAST(analysis_completed_params AS DOUBLE) / analysis_total_params * 40) AS INT) AS search, 50 + CAST(trunc(CAST(analysis_completed_params AS DOUBLE) / analysis_total_params * 35) AS INT) AS ask,
  85 + CAST(trunc(CAST(analysis_completed_params AS DOUBLE) / analysis_total_params * 10) AS INT) AS scan FROM applications WHERE analysis_total_params > 0""")
def stage_progress(spark, sf_dir):
    """What each stage of a case's analysis would show with so many of its parameters done."""
    apps = load(spark, sf_dir, "applications").where("analysis_total_params > 0")
    done, total = F.col("analysis_completed_params"), F.col("analysis_total_params")
    return apps.select("id", *(status.stage_progress(s, done, total).alias(s) for s in ("search", "ask", "scan")))


@query("files", sql="""
SELECT id, regexp_replace(regexp_replace(concat('../x ', original_filename), '[ /]+', '_', 'g'), '^[._]+', '') AS secure, concat('scan v', substr(original_filename, 7, length(original_filename) - 10)) AS stem, '.pdf' AS extension, format('{:,}', application_id * 1000) AS shown FROM files""")
def file_names(spark, sf_dir):
    name = F.concat(F.lit("../x "), "original_filename")
    return load(spark, sf_dir, "files").select("id", display.secure_filename(name).alias("secure"), display.stem(F.col("original_filename")).alias("stem"), display.extension(F.col("original_filename")).alias("extension"), display.thousands(F.col("application_id") * 1000).alias("shown"))


@query("checklist_parameters", sql="SELECT id AS request, llm_model AS model, length(search_query) AS n_chars FROM checklist_parameters")
def asked_models(spark, sf_dir):
    """Every parameter's query sent to its own model, of which the stand-in measures it."""

    def provider(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lengths = pc.utf8_length(batch.column("prompt")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("request"), batch.column("model"), lengths], names=["request", "model", "n_chars"])

    requests = load(spark, sf_dir, "checklist_parameters").select(F.col("id").alias("request"), F.col("llm_model").alias("model"), F.col("search_query").alias("prompt"))
    return extraction.ask(requests, provider, "request bigint, model string, n_chars int")
