"""Chunks of documents: splitting, statistics, filters and size-bounded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_CHARS = 14_000


def split_documents(documents: DataFrame, size: int = 800) -> DataFrame:
    """document_id, chunk_index, text: whole texts cut every `size` characters; a null or empty text has no chunk."""
    n = F.ceil(F.length("text") / size).cast("int")
    rows = documents.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return rows.select(F.col("doc_id").alias("document_id"), "chunk_index", F.substring(F.col("text"), F.col("chunk_index") * size + 1, F.lit(size)).alias("text"))


def usable(chunks: DataFrame) -> DataFrame:
    """Chunks with content: a missing length counts as 0."""
    return chunks.where(F.coalesce("content_length", F.lit(0)) > 0)


def index_stats(chunks: DataFrame) -> DataFrame:
    """n chunks of each case and content type."""
    return chunks.groupBy("application_id", "content_type").agg(F.count("*").alias("n"))


def index_stats_map(chunks: DataFrame) -> DataFrame:
    """total_points and content_types (a map) of each case, as the index reports them."""
    per = index_stats(chunks).groupBy("application_id")
    return per.agg(F.sum("n").alias("total_points"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("content_type", "n")))).alias("content_types"))


def chunk_text(chunk: Column) -> Column:
    """The text of a chunk (a struct with text and metadata); empty where there is none."""
    return F.coalesce(chunk["text"], F.lit(""))


def chunk_metadata(chunk: Column, *names: str) -> list[Column]:
    """The named fields of a chunk's metadata, null where the chunk has none."""
    return [chunk["metadata"][n].alias(n) for n in names]


def chunk_size(content_length: Column, text: Column) -> Column:
    """The stated length, or the text's where none is stated or it is no number."""
    return F.coalesce(content_length.try_cast("int"), F.length(text), F.lit(0))


def sizes_and_tokens(chunks: DataFrame) -> DataFrame:
    """chars and estimated tokens (4 characters each) of each case."""
    per = chunks.groupBy("application_id").agg(F.sum(chunk_size(F.col("content_length"), F.col("text")).cast("bigint")).alias("chars"))
    return per.withColumn("tokens", F.expr("chars div 4"))


def explore(chunks: DataFrame, content_type: str = "all", section: str = "all", document_id: int | None = None, term: str = "") -> DataFrame:
    """The chunk explorer's filter; a null section shows, and filters, as `None`."""
    found = chunks
    if content_type != "all":
        found = found.where(F.col("content_type") == content_type)
    if section != "all":
        found = found.where(F.coalesce("section", F.lit("None")) == section)
    if document_id is not None:
        found = found.where(F.col("document_id") == document_id)
    return found.where(F.lower("text").contains(term.lower())) if term else found


def sections_first_seen(chunks: DataFrame) -> DataFrame:
    """Each case's sections in order of first appearance (document, chunk); empty ones are left out."""
    seen = chunks.where(F.coalesce("section", F.lit("")) != "")
    return seen.groupBy("application_id", "section").agg(F.min(F.struct("document_id", "chunk_index")).alias("first"))


def pack_batches(chunks: DataFrame, max_chars: int = BATCH_CHARS) -> DataFrame:
    """Greedy batches of each case's chunks in document order: adds batch_index and drops chunks of length 0.

    A null or negative length closes the open batch and makes one of its own; so does, in effect, a chunk over the
    limit. What a batch holds hangs on all before it, so a case is one sequence; its narrow rows are streamed in
    order through a task that keeps three numbers, and never gathered. Texts aren't moved: join them by key.
    """
    fields = [("application_id", T.IntegerType()), ("document_id", T.LongType()), ("chunk_index", T.IntegerType()), ("content_length", T.IntegerType()), ("batch_index", T.IntegerType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        import pyarrow as pa

        case, batch, filled, open_ = object(), -1, 0, False
        for rows in batches:
            kept, places = [], []
            for i, (a, n) in enumerate(zip(rows.column(0).to_pylist(), rows.column(3).to_pylist())):
                if a != case:
                    case, batch, filled, open_ = a, -1, 0, False
                if n == 0:
                    continue
                if n is None or n < 0:
                    batch, open_ = batch + 1, False
                elif open_ and filled + n <= max_chars:
                    filled += n
                else:
                    batch, filled, open_ = batch + 1, n, True
                kept.append(i)
                places.append(batch)
            picked = rows.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(places, pa.int32())], names=[f[0] for f in fields])

    order = ["application_id", "document_id", "chunk_index"]
    narrow = chunks.select(*order, "content_length").repartition("application_id").sortWithinPartitions(*order)
    return narrow.mapInArrow(run, schema)


def first_match(batches: DataFrame, found: Column) -> DataFrame:
    """batches: application_id, batch_index, n_chunks; the first batch of each case where `found` holds, and the chunks scanned up to it.

    Cases without one have a null batch and all chunks scanned. One aggregate, without a window.
    """
    hit = F.min(F.when(found, F.col("batch_index")))
    marked = batches.groupBy("application_id").agg(hit.alias("first_batch"), F.sum("n_chunks").alias("n_all"))
    joined = batches.select("application_id", "batch_index", "n_chunks").join(marked, "application_id")
    upto = F.sum(F.when(F.col("first_batch").isNull() | (F.col("batch_index") <= F.col("first_batch")), F.col("n_chunks")))
    return joined.groupBy("application_id", "first_batch").agg(upto.alias("chunks_scanned"))


def page(chunks: DataFrame, application_id: int, limit: int = 1000) -> DataFrame:
    """The first chunks of a case, in document order."""
    return chunks.where(F.col("application_id") == application_id).orderBy("document_id", "chunk_index").limit(limit)


def count_per_document(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """n_chunks of each document (document_id), 0 where it has none."""
    n = chunks.groupBy(F.col("document_id").alias("of")).agg(F.count("*").alias("n"))
    return documents.join(n, F.col("document_id") == F.col("of"), "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))
