"""Similarity search within and across cases.

Scores are ours: the inner product of unit vectors in double precision, and the share of the query's words that
a text holds. Top-k per case is a rank in a window, which Spark limits before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import answers
from casewright.operators.context import contexts
from casewright.operators.text_index import TextIndex
from casewright.operators.vector_index import VectorIndex
from casewright.sources.storage import materialize, scratch_path

RERANK_ALL = 9999
#: Queries under this many characters are searched hybrid where the search is smart.
HYBRID_THRESHOLD = 20
#: What tells the searches of a case apart; a rerank_limit of 0 stands for no reranker.
SEARCH = ["application_id", "query", "search_limit", "rerank_limit"]


def dot(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def text_score(text: Column, words: list[str]) -> Column:
    """Share of the query's words found in the lower-cased text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(lowered.contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / max(1, len(words))


def search_method(query: Column, smart: Column, threshold: int) -> Column:
    return F.when(smart & (F.length(query) < threshold), "hybrid").otherwise("vector")


def vector_scores(chunks: DataFrame, embeddings: DataFrame, query: list[float]) -> DataFrame:
    """Adds `score` to chunk rows that have a vector (by document)."""
    vectors = embeddings.select(F.col("vec_id").alias("document_id"), dot(F.col("embedding"), query).alias("score"))
    return chunks.join(vectors, "document_id")


def hybrid(scored: DataFrame, words: list[str], vector_weight: float = 0.5, text_weight: float = 0.5) -> DataFrame:
    return scored.withColumn("score", vector_weight * F.col("score") + text_weight * text_score(F.col("text"), words))


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best rows of each case with their `position`; ties go to the lower document and chunk."""
    w = Window.partitionBy("application_id").orderBy(F.desc(by), "document_id", "chunk_index")
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def rerank(scored: DataFrame, words: list[str], candidates: int, k: int) -> DataFrame:
    """The best `candidates` of each case by score, scored anew by words (then score), and the best k of these."""
    first = top_k(scored, candidates).drop("position")
    return top_k(first.withColumn("rerank_score", text_score(F.col("text"), words) + F.col("score") / 10), k, "rerank_score")


def stub_vector(query: Column, size: int) -> Column:
    """A unit vector by hashes of the query, in place of an embedding service."""
    raw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (F.pmod(F.xxhash64(query, i), F.lit(2001)) - 1000.5) / 1000)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)


def search_each(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, searches: DataFrame, threshold: int = HYBRID_THRESHOLD) -> DataFrame:
    """SEARCH, position, text: the own hits of every search, up to its own search_limit.

    chunks: application_id, document_id, chunk_index, text. queries: query, vector. searches: SEARCH (distinct). Short
    queries score hybrid, half by vector and half by BM25. With a rerank_limit, so many candidates are scored anew by
    BM25 and a tenth of their score. Vectors are found by an index that skips lists which cannot hold a hit, texts by
    the postings of a query's own terms; a chunk that has none of them is a hit by its vector alone, so the best by
    vector and the chunks with postings hold all hits. No chunk meets every query of its case.
    """
    searches = materialize(searches, "searches")
    deepest = searches.agg(F.max(F.greatest("search_limit", "rerank_limit"))).first()[0] or 0
    asked = materialize(searches.select("application_id", "query").distinct().join(queries, "query"), "asked")
    vectors = embeddings.where("embedding IS NOT NULL").select(F.col("vec_id").alias("document_id"), F.col("embedding").cast("array<double>").alias("vector"))
    chunks = chunks.join(vectors.select("document_id"), "document_id", "left_semi")
    keys = ["application_id", "document_id", "chunk_index"]
    documents = chunks.select("application_id", "document_id").distinct().join(vectors, "document_id")
    index = VectorIndex.build(documents, scratch_path(chunks.sparkSession, "vectors"))
    by_vector = index.search(asked, deepest).select("application_id", "query", "document_id").join(chunks.select(keys), ["application_id", "document_id"])
    hybrid_query = search_method(F.col("query"), F.lit(True), threshold) == "hybrid"
    read = searches.where((F.col("rerank_limit") > 0) | hybrid_query).select("application_id", "query").distinct()
    texts = materialize(TextIndex.build(chunks, read).scores(read), "text-scores")
    found = by_vector.unionByName(texts.where(hybrid_query).select(by_vector.columns)).distinct()
    product = F.aggregate(F.zip_with(F.col("vector"), F.col("asked"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(asked.withColumnRenamed("vector", "asked"), ["application_id", "query"]).join(vectors, "document_id").select("application_id", "query", "document_id", "chunk_index", product.alias("score"))
    scored = scored.join(texts, ["application_id", "query", "document_id", "chunk_index"], "left").withColumn("share", F.coalesce("text_score", F.lit(0.0)))
    scored = scored.withColumn("score", F.when(hybrid_query, 0.5 * F.col("score") + 0.5 * F.col("share")).otherwise(F.col("score")))

    best = Window.partitionBy("application_id", "query").orderBy(F.desc("score"), "document_id", "chunk_index")
    candidates = scored.withColumn("candidate", F.row_number().over(best)).where(F.col("candidate") <= deepest)
    kinds = searches.select("application_id", "query", "rerank_limit").distinct()
    reranked = F.col("rerank_limit") > 0
    found = candidates.join(kinds, ["application_id", "query"]).where(~reranked | (F.col("candidate") <= F.col("rerank_limit")))
    again = Window.partitionBy("application_id", "query", "rerank_limit").orderBy(F.desc(F.when(reranked, F.col("share") + F.col("score") / 10).otherwise(F.col("score"))), "document_id", "chunk_index")
    placed = found.withColumn("position", F.row_number().over(again)).join(searches, ["application_id", "query", "rerank_limit"]).where(F.col("position") <= F.col("search_limit"))
    return placed.join(chunks.select(*keys, "text"), keys).select(*SEARCH, "position", "text")


def rerank_limit(stats: DataFrame) -> DataFrame:
    """stats: total_points (null where the index didn't tell); the limit that `all` stands for over these cases."""
    total = F.sum(F.coalesce("total_points", F.lit(100)))
    return stats.agg(F.when(total > 0, total).otherwise(1000).alias("rerank_limit"))


def across_cases(scored: DataFrame, application_ids: list[int], k: int) -> DataFrame:
    """The full k of each requested case, in request order: position within the case, and global_position."""
    order = F.array(*(F.lit(i) for i in application_ids))
    best = top_k(scored.where(F.col("application_id").isin(application_ids)), k).withColumn("app_position", F.array_position(order, F.col("application_id")))
    # At most k rows for each requested case stand in the one window.
    return best.withColumn("global_position", F.row_number().over(Window.orderBy("app_position", "position")))


def document_key(path: Column) -> Column:
    """doc_ and the file's base name, blanks and dots replaced."""
    return F.concat(F.lit("doc_"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[ .]", "_"))


def merged_names(files: DataFrame, application_ids: list[int]) -> DataFrame:
    """document key -> name over the requested cases; the last requested case wins, in it the last file."""
    order = F.array(*(F.lit(i).cast("bigint") for i in application_ids))
    rows = files.where(F.col("application_id").isin(application_ids)).select(document_key(F.col("file_path")).alias("document_id"), "original_filename", F.array_position(order, F.col("application_id")).alias("place"), "id")
    return rows.groupBy("document_id").agg(F.max_by("original_filename", F.struct("place", "id")).alias("name"))


def rerank_share(limit: int, n_cases: int) -> int:
    """Each case's part of the rerank limit in a search over several; it may be 0."""
    return limit // n_cases if n_cases > 1 else limit


def envelope(count: Column, method: Column, use_llm: Column, seconds: Column, application_ids: list[int] | None = None) -> Column:
    """The JSON that a finished search answers with; several cases are named."""
    fields = [F.lit("success").alias("status"), count.alias("count"), method.alias("search_method"), use_llm.alias("use_llm"), F.round(seconds, 2).alias("execution_time")]
    if application_ids and len(application_ids) > 1:
        fields += [F.array(*map(F.lit, application_ids)).alias("application_ids"), F.lit(True).alias("multi_search")]
    return F.to_json(F.struct(*fields))


def shaped(hits: DataFrame, names: DataFrame, *more: str) -> DataFrame:
    """Hits as the interface shows them: defaults for what is missing, scores to four places. names: document_id, name; more: columns to keep."""
    n = names.select(F.col("document_id").alias("n_id"), "name")
    joined = hits.join(n, F.col("document_id") == F.col("n_id"), "left")
    return joined.select(
        "application_id",
        "position",
        *more,
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("document_id").cast("string"), F.lit("")).alias("document_id"),
        F.coalesce("name", F.lit("Неизвестный документ")).alias("document_name"),
        F.coalesce(F.col("page_number").cast("string"), F.lit("Не указана")).alias("page"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
        F.lit("vector").alias("search_type"),
    )


def detailed(hits: DataFrame, names: DataFrame, *more: str) -> DataFrame:
    """`shaped` with metadata (section, content_type), and rerank_score to four places where hits have one; several cases' hits (with global_position) lose it."""
    details = [F.struct("section", "content_type").alias("metadata")]
    if "rerank_score" in hits.columns and "global_position" not in more:
        details.append(F.round("rerank_score", 4).alias("rerank_score"))
    keys = ["application_id", "position"]
    own = hits.select(*(F.col(k).alias(f"d_{k}") for k in keys), *details)
    joined = shaped(hits, names, *more).join(own, (F.col("application_id") == F.col("d_application_id")) & (F.col("position") == F.col("d_position")))
    return joined.drop("d_application_id", "d_position")


def answered(hits: DataFrame, questions: DataFrame, respond, most: int) -> DataFrame:
    """application_id, value, confidence, raw_response: the model's answer over the first `most` hits of each case, parsed; cases without hits have none.

    questions: application_id, query. `respond(query, context)` makes the response from columns; null (a failed call)
    gives null. The value is the parser's, the confidence that of the text alone.
    """
    read = contexts(hits, ["application_id"], most=most).join(questions, "application_id")
    asked = read.withColumn("raw_response", respond(F.col("query"), F.col("context")))
    told = F.col("raw_response").isNotNull()
    value = answers.parse_full(F.coalesce("raw_response", F.lit("")), F.col("query"))["value"]
    return asked.select("application_id", F.when(told, value).alias("value"), F.when(told, answers.confidence(F.col("raw_response"))).alias("confidence"), "raw_response")
