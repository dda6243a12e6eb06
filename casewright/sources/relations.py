"""The domain's relations (cases, files, checklists, chunks ...), derived from the driver's tables.

Each is stated once as SQL that Spark and DuckDB read alike; `{table}` stands for a driver table. All are
narrow projections, joins or per-key windows of one table, so Catalyst prunes and pushes through them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from casewright.sources import partitions

_CHUNK_COLUMNS = """SELECT CAST(substr(source, 4) AS INT) AS application_id, doc_id AS document_id, CAST(i AS INT) AS chunk_index,
  substr(text, CAST(i * 800 + 1 AS INT), 800) AS text,
  CAST(CASE WHEN (doc_id + i) % 29 = 0 THEN 0 WHEN (doc_id + i) % 31 = 0 THEN NULL WHEN (doc_id + i) % 37 = 0 THEN -1
       ELSE length(substr(text, CAST(i * 800 + 1 AS INT), 800)) END AS INT) AS content_length,
  CAST(1 + floor(i / 3) AS INT) AS page_number,
  CASE (doc_id + i) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'heading' END AS content_type,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS section
FROM (SELECT *, """

RELATIONS = {
    "users": """SELECT c_custkey AS id, c_name AS username, concat(lower(c_name), '@example.org') AS email,
  CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 1 THEN 'prompt_engineer' ELSE 'user' END AS role FROM {customer}""",
    "applications": """SELECT o_orderkey AS id, concat('case ', o_orderpriority, ' ', CAST(o_orderkey AS STRING)) AS name,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_custkey END AS user_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 13 = 0 THEN 'analyzing' WHEN o_orderkey % 17 = 0 THEN 'indexing'
       WHEN o_orderstatus = 'F' THEN 'analyzed' WHEN o_orderstatus = 'O' THEN 'indexed' ELSE 'created' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'indexing' ELSE 'analyzing' END AS last_operation, o_orderdate AS created_at,
  CAST(o_orderkey % 9 AS INT) AS analysis_total_params,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE (o_orderkey * 7) % (o_orderkey % 9 + 1) END AS INT) AS analysis_completed_params FROM {orders}""",
    "files": """SELECT l_orderkey * 10000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS id,
  l_orderkey AS application_id, concat('uploads/', CAST(l_partkey AS STRING), '_scan v', CAST(l_linenumber AS STRING), '.pdf') AS file_path,
  concat('scan v', CAST(l_linenumber AS STRING), '.pdf') AS original_filename,
  CASE WHEN l_partkey % 20 = 0 THEN 'error' WHEN l_partkey % 20 = 1 THEN 'indexing' WHEN l_partkey % 20 = 2 THEN 'pending' ELSE 'completed' END AS indexing_status,
  CASE WHEN l_partkey % 20 = 0 THEN concat('failed part ', CAST(l_partkey AS STRING)) ELSE NULL END AS error_message,
  CAST(l_quantity AS INT) AS chunks_count, l_shipdate AS indexing_started_at,
  CASE WHEN l_partkey % 20 IN (1, 2) THEN NULL ELSE CAST((l_suppkey * 37 + l_partkey) % 7200 AS INT) END AS indexing_seconds FROM {lineitem}""",
    "checklists": "SELECT s_suppkey AS id, s_name AS name, s_suppkey * 3 AS user_id, s_nationkey % 3 = 0 AS is_public FROM {supplier}",
    "application_checklists": "SELECT DISTINCT l_orderkey AS application_id, l_suppkey AS checklist_id FROM {lineitem} WHERE l_suppkey % 10 <> 0",
    "checklist_parameters": """SELECT x.l_suppkey * 1000000 + x.l_partkey AS id, x.l_suppkey AS checklist_id, p_name AS name, lower(p_name) AS search_query,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE concat(p_name, ' ', p_type) END AS llm_query,
  CAST(row_number() OVER (PARTITION BY x.l_suppkey ORDER BY x.l_partkey) - 1 AS INT) AS order_index,
  p_size % 2 = 0 AS use_full_scan, p_size % 5 = 0 AS use_reranker, CAST(1 + p_size % 8 AS INT) AS search_limit, p_brand AS llm_model
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) x JOIN {part} ON p_partkey = x.l_partkey""",
    "parameter_results": """SELECT id, application_id, parameter_id, value, confidence FROM (
  SELECT l_orderkey * 10000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS id, l_orderkey AS application_id, l_suppkey * 1000000 + l_partkey AS parameter_id,
    CASE WHEN l_linenumber = 1 THEN 'Информация не найдена' ELSE concat(l_returnflag, l_linestatus) END AS value, l_discount + 0.0 AS confidence,
    row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount) AS rn
  FROM {lineitem} WHERE l_suppkey % 10 <> 0) t WHERE rn = 1""",
    "stored_results": """SELECT id + CAST(k * 5000000000000 AS BIGINT) AS id, application_id, parameter_id, concat(value, CAST(k AS STRING)) AS value, confidence, created_at FROM (
  SELECT l_orderkey * 10000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS id, l_orderkey AS application_id,
    l_suppkey * 1000000 + l_partkey AS parameter_id, concat(l_returnflag, l_linestatus) AS value, l_discount + 0.0 AS confidence, l_shipdate AS created_at, l_linenumber
  FROM {lineitem} WHERE l_suppkey % 10 <> 0) t CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) c WHERE k = 0 OR l_linenumber % 2 = 0""",
    "task_events": """SELECT event_id, ts, concat('task-', CAST(user_id AS STRING)) AS task_id,
  CASE event_type WHEN 'view' THEN 'PROGRESS' WHEN 'click' THEN 'PROGRESS' WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILURE' END AS state,
  CAST(floor(value) AS INT) AS progress FROM {events}""",
    "llm_answers": """SELECT conv_id, turn, 'значение параметра' AS q,
  CASE (conv_id + turn) % 8
    WHEN 0 THEN concat('{{"value": "v', CAST(conv_id AS STRING), '", "page": "', CAST(turn AS STRING), '"}}')
    WHEN 1 THEN concat('Ответ модели ```json {{"result": ', CAST(turn AS STRING), '}} ```')
    WHEN 2 THEN concat('Результат: v', CAST(conv_id AS STRING))
    WHEN 3 THEN concat('Значение параметра : ', CAST(conv_id AS STRING))
    WHEN 4 THEN 'Информация не найдена.'
    WHEN 5 THEN concat('- параметра ', CAST(turn AS STRING))
    WHEN 6 THEN ''
    ELSE text END AS response
FROM {conversations} WHERE role = 'assistant'""",
    "chunks": _CHUNK_COLUMNS + "explode(sequence(0, CAST((n_chars - 1) div 800 AS INT))) AS i FROM {documents}) d",
}
#: Where the row generator differs by engine.
DUCKDB = {"chunks": _CHUNK_COLUMNS + "unnest(range(0, CAST((n_chars - 1) // 800 + 1 AS BIGINT))) AS i FROM {documents}) d"}


def load(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A relation over the Parquet tables in `sf_dir`; a relation of one table may have it dealt out by a column, in as many tasks as its size asks for."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"(?<!{){(\w+)}", RELATIONS[name]))}
    if by:
        tables = {t: df.repartition(partitions.parts(df), by) for t, df in tables.items()}
    return spark.sql(RELATIONS[name], **tables)


def with_clause(*names: str, recursive: bool = False) -> str:
    """The relations as common table expressions of the reference SQL."""
    parts = []
    for name in names:
        sql = DUCKDB.get(name, RELATIONS[name])
        tables = set(re.findall(r"(?<!{){(\w+)}", sql))
        parts.append(f"{name} AS ({sql.format(**{t: t for t in tables})})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
