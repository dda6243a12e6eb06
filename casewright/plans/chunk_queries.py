"""Queries over chunks: statistics, packing, retrieval and scans."""

from __future__ import annotations

from pyspark.sql import functions as F


from casewright.operators import chunks, context, extraction, report, retrieval, text_index
from casewright.operators.vector_index import VectorIndex
from casewright.plans.registry import query
from casewright.sources.relations import load
from casewright.sources.storage import materialize, scratch_path

APPS = [5, 1, 12]
QUERY_ID = 17
WORDS = ["the", "und", "zqx"]
_IN = ", ".join(map(str, APPS))

_SCORED = f"""+ q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id = {QUERY_ID}),
s AS (SELECT c.*, list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q.v) AS score FROM chunks c JOIN embeddings ON vec_id = document_id, q)"""
_TEXT = "(" + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1.0 ELSE 0.0 END" for w in WORDS) + f") / {len(WORDS)}"


def _query_vector(spark, sf_dir) -> list[float]:
    """One row by its key: the query, as an embedding service would give it."""
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == QUERY_ID).first().embedding)


def _scored(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return retrieval.vector_scores(load(spark, sf_dir, "chunks"), vectors, _query_vector(spark, sf_dir))


@query("chunks", sql="SELECT application_id, content_type, count(*) AS n FROM chunks GROUP BY 1, 2")
def index_stats(spark, sf_dir):
    return chunks.index_stats(load(spark, sf_dir, "chunks"))


@query("chunks", sql="SELECT application_id, CAST(sum(coalesce(content_length, length(text))) AS BIGINT) AS chars, CAST(sum(coalesce(content_length, length(text))) AS BIGINT) // 4 AS tokens FROM chunks GROUP BY 1")
def chunk_sizes_tokens(spark, sf_dir):
    return chunks.sizes_and_tokens(load(spark, sf_dir, "chunks"))


@query("chunks", sql="""SELECT document_id, chunk_index FROM chunks WHERE content_type = 'table' AND section IS NULL AND contains(lower(text), 'the')
UNION ALL SELECT document_id, chunk_index FROM chunks WHERE section = 'de'""")
def chunk_filter(spark, sf_dir):
    c, keys = load(spark, sf_dir, "chunks"), ["document_id", "chunk_index"]
    return chunks.explore(c, "table", "None", None, "The").select(keys).unionAll(chunks.explore(c, section="de").select(keys))


@query(sql="SELECT document_id, chunk_index, substr(text, CAST(chunk_index * 800 + 1 AS INT), 800) AS text FROM (SELECT doc_id AS document_id, text, CAST(unnest(range(0, (length(text) + 799) // 800)) AS INT) AS chunk_index FROM documents)")
def split_documents(spark, sf_dir):
    return chunks.split_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("chunks", sql="""
+ f AS (SELECT application_id, section, min(document_id * 100000 + chunk_index) AS k FROM chunks WHERE section IS NOT NULL GROUP BY 1, 2)
SELECT application_id, section, k // 100000 AS document_id, CAST(k % 100000 AS INT) AS chunk_index FROM f""")
def sections_first_seen(spark, sf_dir):
    return chunks.sections_first_seen(load(spark, sf_dir, "chunks")).select("application_id", "section", "first.document_id", "first.chunk_index")


#: Greedy batches by recursion over a case's numbered chunks: f is the open batch's size, -1 where none is open.
_BATCHES = f""", n AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY document_id, chunk_index) AS i FROM chunks WHERE content_length IS NULL OR content_length <> 0),
b AS (SELECT application_id, document_id, chunk_index, content_length, i, 0 AS batch_index, CASE WHEN content_length > 0 THEN content_length ELSE -1 END AS f FROM n WHERE i = 1
  UNION ALL SELECT n.application_id, n.document_id, n.chunk_index, n.content_length, n.i, CASE WHEN n.content_length > 0 AND b.f >= 0 AND b.f + n.content_length <= {chunks.BATCH_CHARS} THEN b.batch_index ELSE b.batch_index + 1 END,
    CASE WHEN n.content_length IS NULL OR n.content_length < 0 THEN -1 WHEN b.f >= 0 AND b.f + n.content_length <= {chunks.BATCH_CHARS} THEN b.f + n.content_length ELSE n.content_length END
  FROM b JOIN n ON n.application_id = b.application_id AND n.i = b.i + 1)"""


@query("chunks", sql="+" + _BATCHES[1:] + " SELECT application_id, document_id, chunk_index, content_length, CAST(batch_index AS INT) AS batch_index FROM b", recursive=True)
def pack_batches(spark, sf_dir):
    return chunks.pack_batches(load(spark, sf_dir, "chunks"))


@query("chunks", sql=_SCORED + """
SELECT application_id, document_id, chunk_index, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) AS INT) AS position FROM s QUALIFY position <= 5""")
def vector_topk(spark, sf_dir):
    return retrieval.top_k(_scored(spark, sf_dir), 5).select("application_id", "document_id", "chunk_index", F.round("score", 4).alias("score"), "position")


@query("chunks", sql=_SCORED + """,
d AS (SELECT DISTINCT application_id, document_id, score FROM s)
SELECT application_id, document_id, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id) AS INT) AS position FROM d QUALIFY position <= 5""")
def indexed_topk(spark, sf_dir):
    """The five best documents of each case by an inverted file, exactly: lists whose bound is under the fifth score are not read."""
    own = load(spark, sf_dir, "chunks").select("application_id", "document_id").distinct()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("vector"))
    index = VectorIndex.build(own.join(vectors, "document_id"), scratch_path(spark, "vectors"))
    asked = F.array(*map(F.lit, map(float, _query_vector(spark, sf_dir)))).alias("vector")
    found = index.search(own.select("application_id", F.lit("q").alias("query"), asked).distinct(), 5)
    return found.select("application_id", "document_id", F.round("score", 4).alias("score"), "position")


_ASKED = "SELECT DISTINCT application_id, query FROM chunks, (VALUES ('the And of und'), ('tion re'), ('zqx en, de')) v(query)"
_BM25 = rf"""
+ a AS ({_ASKED}),
t AS (SELECT application_id, document_id, chunk_index, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS terms FROM chunks),
p AS (SELECT application_id, document_id, chunk_index, size, term, count(*) AS n FROM (SELECT application_id, document_id, chunk_index, len(terms) AS size, unnest(terms) AS term FROM t) GROUP BY ALL),
f AS (SELECT application_id, term, count(*) AS df FROM p GROUP BY ALL), c AS (SELECT application_id, count(*) AS n_chunks, avg(len(terms)) AS mean FROM t GROUP BY ALL),
q AS (SELECT DISTINCT application_id, query, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS term FROM a),
w AS (SELECT q.*, c.mean, ln(1 + (n_chunks - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM q JOIN c USING (application_id) LEFT JOIN f USING (application_id, term)),
m AS (SELECT application_id, query, sum(idf) * {text_index.K1 + 1} AS most FROM w GROUP BY ALL),
b AS (SELECT application_id, query, document_id, chunk_index, sum(idf * n * {text_index.K1 + 1} / (n + {text_index.K1} * ({1 - text_index.B} + {text_index.B} * size / mean))) AS sum FROM p JOIN w USING (application_id, term) GROUP BY ALL),
x AS (SELECT application_id, query, document_id, chunk_index, round(sum / most, {text_index.PLACES}) AS text_score FROM b JOIN m USING (application_id, query))"""


def _asked(chunks):
    return chunks.select("application_id", F.explode(F.array(*map(F.lit, ("the And of und", "tion re", "zqx en, de")))).alias("query")).distinct()


@query("chunks", sql=_BM25 + """
SELECT application_id, query, document_id, chunk_index, round(text_score, 6) AS text_score, CAST(row_number() OVER (PARTITION BY application_id, query ORDER BY text_score DESC, document_id, chunk_index) AS INT) AS position FROM x QUALIFY position <= 5""")
def bm25_topk(spark, sf_dir):
    """The five best chunks of each case for three queries, by the postings of their terms."""
    c = load(spark, sf_dir, "chunks")
    index = text_index.TextIndex.build(c).write(scratch_path(spark, "texts"))
    return index.search(_asked(c), 5).withColumn("text_score", F.round("text_score", 6))


_OWN = _BM25.replace("AS terms FROM chunks)", "AS terms FROM chunks WHERE document_id IN (SELECT vec_id FROM embeddings))")


@query("chunks", sql=_OWN + f""",
qv AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id = {QUERY_ID}),
h AS (SELECT c.application_id, a.query, c.document_id, c.chunk_index, c.text, 0.5 * list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), qv.v) + 0.5 * coalesce(text_score, 0) AS score, coalesce(text_score, 0) AS share
  FROM chunks c JOIN embeddings ON vec_id = c.document_id JOIN a ON a.application_id = c.application_id CROSS JOIN qv
  LEFT JOIN x ON x.application_id = c.application_id AND x.query = a.query AND x.document_id = c.document_id AND x.chunk_index = c.chunk_index),
k AS (SELECT *, row_number() OVER (PARTITION BY application_id, query ORDER BY score DESC, document_id, chunk_index) AS place FROM h QUALIFY place <= 10),
r AS (SELECT *, 4 AS search_limit, 0 AS rerank_limit, place AS position FROM k WHERE place <= 4
  UNION ALL SELECT *, 3, 10, row_number() OVER (PARTITION BY application_id, query ORDER BY share + score / 10 DESC, document_id, chunk_index) FROM k QUALIFY row_number() OVER (PARTITION BY application_id, query ORDER BY share + score / 10 DESC, document_id, chunk_index) <= 3)
SELECT application_id, query, search_limit, rerank_limit, CAST(position AS INT) AS position, md5(text) AS text_md5 FROM r""")
def searched_cases(spark, sf_dir):
    """Hybrid searches of every case, plain and reranked, as the analysis makes them; only documents with a vector take part."""
    c, vectors = load(spark, sf_dir, "chunks"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = _asked(c)
    queries = asked.select("query").distinct().withColumn("vector", F.array(*map(F.lit, map(float, _query_vector(spark, sf_dir)))))
    searches = asked.withColumn("s", F.explode(F.array(F.struct(F.lit(4).alias("search_limit"), F.lit(0).alias("rerank_limit")), F.struct(F.lit(3).alias("search_limit"), F.lit(10).alias("rerank_limit")))))
    hits = retrieval.search_each(c, vectors, queries, searches.select("application_id", "query", "s.*"))
    return hits.select(*retrieval.SEARCH, "position", F.md5("text").alias("text_md5"))


@query("chunks", sql=_SCORED + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) AS position FROM s WHERE application_id IN ({_IN}) QUALIFY position <= 5)
SELECT application_id, document_id, chunk_index, CAST(position AS INT) AS position, CAST(row_number() OVER (ORDER BY list_position([{_IN}], application_id), position) AS INT) AS global_position FROM t""")
def multi_app_topk(spark, sf_dir):
    return retrieval.across_cases(_scored(spark, sf_dir), APPS, 5).select("application_id", "document_id", "chunk_index", "position", "global_position")


@query("chunks", sql=_SCORED + f""",
h AS (SELECT application_id, document_id, chunk_index, 0.5 * score + 0.5 * ({_TEXT}) AS score FROM s)
SELECT application_id, document_id, chunk_index, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) AS INT) AS position FROM h QUALIFY position <= 3""")
def hybrid_topk(spark, sf_dir):
    return retrieval.top_k(retrieval.hybrid(_scored(spark, sf_dir), WORDS), 3).select("application_id", "document_id", "chunk_index", F.round("score", 4).alias("score"), "position")


@query("chunks", sql=_SCORED + f""",
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) <= 10),
r AS (SELECT application_id, document_id, chunk_index, ({_TEXT}) + score / 10 AS rerank_score FROM c)
SELECT application_id, document_id, chunk_index, round(rerank_score, 4) AS rerank_score, CAST(row_number() OVER (PARTITION BY application_id ORDER BY rerank_score DESC, document_id, chunk_index) AS INT) AS position FROM r QUALIFY position <= 3""")
def rerank_topk(spark, sf_dir):
    return retrieval.rerank(_scored(spark, sf_dir), WORDS, 10, 3).select("application_id", "document_id", "chunk_index", F.round("rerank_score", 4).alias("rerank_score"), "position")


@query("chunks", sql="""
+ p AS (SELECT application_id, CASE WHEN application_id % 4 = 0 THEN NULL ELSE count(*) END AS total_points FROM chunks GROUP BY 1)
SELECT CAST(CASE WHEN sum(coalesce(total_points, 100)) > 0 THEN sum(coalesce(total_points, 100)) ELSE 1000 END AS BIGINT) AS rerank_limit FROM p""")
def rerank_all_limit(spark, sf_dir):
    per = load(spark, sf_dir, "chunks").groupBy("application_id").agg(F.count("*").alias("n"))
    return retrieval.rerank_limit(per.select(F.when(F.col("application_id") % 4 != 0, F.col("n")).alias("total_points")))


_NAMES = "SELECT doc_id AS id, concat('doc ', doc_id) AS name FROM documents WHERE lang <> 'fr'"


def _names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang <> 'fr'")
    return docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"))


@query("chunks", sql=_SCORED + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) AS position FROM s QUALIFY position <= 3)
SELECT application_id, CAST(position AS INT) AS position, text, CAST(document_id AS VARCHAR) AS document_id, coalesce(n.name, 'Неизвестный документ') AS document_name, CAST(page_number AS VARCHAR) AS page, round(score, 4) AS score, 'vector' AS search_type
FROM t LEFT JOIN ({_NAMES}) n ON n.id = document_id""")
def shaped_results(spark, sf_dir):
    return retrieval.shaped(retrieval.top_k(_scored(spark, sf_dir), 3), _names(spark, sf_dir))


@query("files", sql="""
SELECT 'doc_' || replace(replace(split_part(file_path, '/', 2), ' ', '_'), '.', '_') AS document_id, arg_max(original_filename, CAST(list_position([3, 1, 2], application_id) AS BIGINT) * 1000000000 + id) AS name FROM files WHERE application_id IN (1, 2, 3) GROUP BY 1""")
def doc_name_merge(spark, sf_dir):
    return retrieval.merged_names(load(spark, sf_dir, "files"), [3, 1, 2])


_BLOCK = "concat('===== Результат ', position, ' =====\n[Источник: ', CASE WHEN n.name IS NOT NULL THEN concat('Документ: ', n.name) ELSE concat('Документ ID: ', document_id) END, ', Страница: ', page_number, ', Чанк: ', chunk_index, ']\n\n', text, '\n==============================\n')"
_CONTEXT = f""",
t AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) AS position FROM s QUALIFY position <= 4),
k AS (SELECT application_id, string_agg({_BLOCK}, '\n' ORDER BY position) AS context FROM t LEFT JOIN ({_NAMES}) n ON n.id = document_id GROUP BY 1)"""


def _contexts(spark, sf_dir):
    names = _names(spark, sf_dir).select(F.col("document_id").alias("n_id"), F.col("name").alias("document_name"))
    hits = retrieval.top_k(_scored(spark, sf_dir), 4).join(names, F.col("document_id") == F.col("n_id"), "left")
    return context.contexts(hits, ["application_id"], most=8)


@query("chunks", sql=_SCORED + _CONTEXT + " SELECT application_id, context FROM k")
def context_blocks(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query("chunks", sql=_SCORED + _CONTEXT + " SELECT application_id, concat('Find \"q', application_id, '\" as {\"value\": \"...\"} in:\n', context) AS prompt FROM k")
def prompts(spark, sf_dir):
    asked = F.concat(F.lit("q"), F.col("application_id").cast("string"))
    return _contexts(spark, sf_dir).select("application_id", context.prompt('Find "{query}" as {{"value": "..."}} in:\n{context}', asked, F.col("context")).alias("prompt"))


@query("chunks", sql=f"""
+ p AS (SELECT DISTINCT application_id, document_id, page_number FROM chunks WHERE contains(text, 'as an')), g AS (SELECT *, page_number - row_number() OVER (PARTITION BY application_id, document_id ORDER BY page_number) AS k FROM p),
i AS (SELECT application_id, document_id, k, min(page_number) AS a, max(page_number) AS b FROM g GROUP BY 1, 2, 3)
SELECT application_id, document_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END, ', ' ORDER BY a) AS ranges FROM i GROUP BY 1, 2""")
def page_ranges(spark, sf_dir):
    return report.page_ranges(load(spark, sf_dir, "chunks").where(F.col("text").contains("as an")), ["application_id", "document_id"])


@query("chunks", sql=_SCORED + f""",
t AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) AS position FROM s QUALIFY position <= 6)
SELECT application_id, coalesce(n.name, CAST(document_id AS VARCHAR)) AS document, page_number, CAST(min(position) AS INT) AS place FROM t LEFT JOIN ({_NAMES}) n ON n.id = document_id GROUP BY 1, 2, 3""")
def report_sources(spark, sf_dir):
    names = _names(spark, sf_dir).select(F.col("document_id").alias("n_id"), F.col("name").alias("document_name"))
    hits = retrieval.top_k(_scored(spark, sf_dir), 6).join(names, F.col("document_id") == F.col("n_id"), "left")
    return report.sources(hits, ["application_id"])


_MARK = "scum"
_SIZES = ", z AS (SELECT b.application_id, b.batch_index, count(*) AS n_chunks, max(CASE WHEN contains(lower(c.text), '{w}') THEN 1 ELSE 0 END) AS hit FROM b JOIN chunks c USING (document_id, chunk_index) GROUP BY 1, 2)"


@query("chunks", sql="+" + _BATCHES[1:] + _SIZES.format(w=_MARK) + """, m AS (SELECT application_id, min(batch_index) FILTER (hit = 1) AS first_batch FROM z GROUP BY 1)
SELECT application_id, CAST(first_batch AS INT) AS first_batch, CAST(sum(n_chunks) FILTER (first_batch IS NULL OR batch_index <= first_batch) AS BIGINT) AS chunks_scanned FROM z JOIN m USING (application_id) GROUP BY 1, 2""", recursive=True)
def full_scan_first_match(spark, sf_dir):
    c = load(spark, sf_dir, "chunks")
    packed = chunks.pack_batches(c).join(c.select("document_id", "chunk_index", "text"), ["document_id", "chunk_index"])
    sizes = packed.groupBy("application_id", "batch_index").agg(F.count("*").alias("n_chunks"), F.max(F.lower("text").contains(_MARK)).alias("hit"))
    return chunks.first_match(sizes, F.col("hit"))


def _batch_texts(packed):
    # A batch holds at most BATCH_CHARS characters, so what is gathered is bounded.
    batches = packed.groupBy("application_id", "batch_index").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_list(F.struct("document_id", "chunk_index", "text"))).alias("x"))
    return batches.select("application_id", "batch_index", "n_chunks", F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))


@query("chunks", "checklist_parameters", sql=_SCORED.replace("+ q", _BATCHES[1:] + ", q").replace(" n AS", "+ n AS", 1) + """,
t AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY score DESC, document_id, chunk_index) AS position FROM s QUALIFY position <= 3),
w AS (SELECT checklist_id % 20 AS application_id, id AS parameter_id, string_split(search_query, ' ')[1] AS word, use_full_scan FROM checklist_parameters WHERE checklist_id <= 3 UNION ALL SELECT checklist_id % 20, -2 * id, 'scum', true FROM checklist_parameters WHERE checklist_id <= 3 AND order_index = 0 UNION ALL SELECT checklist_id % 20, -2 * id - 1, 'the', false FROM checklist_parameters WHERE checklist_id <= 3 AND order_index = 0),
a AS (SELECT w.*, position, strpos(lower(text), word) AS pos, substr(text, CAST(strpos(lower(text), word) AS INT), 40) AS piece FROM w JOIN t USING (application_id)),
f AS (SELECT application_id, parameter_id, word, use_full_scan, arg_min(piece, position) FILTER (pos > 0) AS piece FROM a GROUP BY 1, 2, 3, 4),
z AS (SELECT b.application_id, b.batch_index, count(*) AS n_chunks, string_agg(c.text, ' ' ORDER BY b.document_id, b.chunk_index) AS text FROM b JOIN chunks c USING (document_id, chunk_index) WHERE b.content_length > 0 GROUP BY 1, 2),
o AS (SELECT f.application_id, parameter_id, batch_index, n_chunks, strpos(lower(text), word) AS pos, substr(text, CAST(strpos(lower(text), word) AS INT), 40) AS piece FROM f JOIN z USING (application_id) WHERE piece IS NULL AND use_full_scan),
h AS (SELECT application_id, parameter_id, min(batch_index) FILTER (pos > 0) AS first, arg_min(piece, batch_index) FILTER (pos > 0) AS value, sum(n_chunks) AS n_all FROM o GROUP BY 1, 2)
SELECT application_id, parameter_id, coalesce(piece, 'Информация не найдена') AS value, CASE WHEN piece IS NULL THEN 0.1 ELSE round(0.7 + 0.1, 4) END AS confidence, CAST(NULL AS BIGINT) AS chunks_scanned FROM f WHERE piece IS NOT NULL OR NOT use_full_scan
UNION ALL SELECT application_id, parameter_id, CASE WHEN first IS NULL THEN concat('Информация не найдена по всем ', CAST(n_all AS BIGINT), ' чанкам') ELSE value END, CASE WHEN first IS NULL THEN 0.1 ELSE 0.9 END,
  CAST(CASE WHEN first IS NULL THEN n_all ELSE (SELECT sum(n_chunks) FROM z WHERE z.application_id = h.application_id AND z.batch_index <= first) END AS BIGINT) FROM h""", recursive=True)
def checklist_pipeline(spark, sf_dir):
    """Three checklists' parameters, each asked in the case of its number, with a deterministic stand-in for the model."""
    p = load(spark, sf_dir, "checklist_parameters").where("checklist_id <= 3")
    case = (F.col("checklist_id") % 20).cast("int").alias("application_id")
    words = p.select(case, F.col("id").alias("parameter_id"), F.element_at(F.split("search_query", " "), 1).alias("word"), "use_full_scan")
    first = p.where("order_index = 0")
    words = words.unionAll(first.select(case, -2 * F.col("id"), F.lit("scum"), F.lit(True))).unionAll(first.select(case, -2 * F.col("id") - 1, F.lit("the"), F.lit(False)))
    c = load(spark, sf_dir, "chunks")
    hits = retrieval.top_k(_scored(spark, sf_dir), 3).select("application_id", "position", "text")
    packed = chunks.pack_batches(c).where("content_length > 0").join(c.select("document_id", "chunk_index", "text"), ["document_id", "chunk_index"])
    batches = _batch_texts(packed)
    return extraction.run_checklists(words, hits, batches).withColumn("confidence", F.round("confidence", 4))


#: Candidates of a reranked search, as the parameters' own default has it.
RERANK_LIMIT = 10


@query("chunks", "checklist_parameters")
def checklist_analysis(spark, sf_dir):
    """All checklists' parameters, each searched by its own query in the case of its checklist's number, answered, and fully scanned for where asked."""
    rerank = F.when(F.col("use_reranker"), RERANK_LIMIT).otherwise(0).alias("rerank_limit")
    case = (F.col("checklist_id") % 20).cast("int").alias("application_id")
    asked = load(spark, sf_dir, "checklist_parameters").select(case, F.col("id").alias("parameter_id"), F.lower("search_query").alias("query"), "search_limit", rerank, "use_full_scan")
    asked = materialize(asked.withColumn("word", F.element_at(F.split("query", " "), 1)), "parameters")  # read several times, which would each deal the lines out
    c, vectors = load(spark, sf_dir, "chunks"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = vectors.select(F.size("embedding").alias("n")).first()
    queries = asked.select("query").distinct().withColumn("vector", retrieval.stub_vector(F.col("query"), one.n if one else 1))
    hits = retrieval.search_each(c, vectors, queries, asked.select(retrieval.SEARCH).distinct())
    packed = chunks.pack_batches(chunks.usable(c)).join(c.select("document_id", "chunk_index", "text"), ["document_id", "chunk_index"])
    return extraction.run_checklists(asked, hits, _batch_texts(packed), retrieval.SEARCH).withColumn("confidence", F.round("confidence", 4))
