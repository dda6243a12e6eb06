"""Token ids as ORC files, in ascending order of document ids.

Integer columns use ORC's run-length encoding; every stripe has a row index, and Bloom filters and min/max
figures of document ids let a reader skip files, stripes and row groups. Stripes are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions
from .tokens import FileEncoder, worker_encoder

END_ID = 1
#: So many words keep their ids in a worker.
MEMO = 1_000_000


def tokenize(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, keeps_spaces: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids array<int>: the ids of each whole text, then end_id; start counts the ids before it in its partition. Keeps the rows' order and partitions."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, before = to_arrow_schema(schema), 0
        encode_all = worker_encoder(FileEncoder, tokenizer, keeps_spaces, MEMO).encode_all
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ends, ids = encode_all(part.column(1))
                ids = np.insert(ids, ends[1:], end_id)
                ends += np.arange(len(ends))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), lists.cast(arrow.field(3).type)], schema=arrow)
                before += int(ends[-1])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, keeps_spaces: bool = False, partitions: int | None = None, stripe_bytes: int = 64 << 20, index_stride: int = 1000) -> None:
    """Writes doc_id, start, n_tokens, ids, part in ascending doc_id order (nulls first) over range-partitioned files.

    Texts cross the network once and are tokenised after that, since a range exchange reads its input twice.
    `part` numbers the files in order of the ids, `start` counts the ids before a document in its file. Rows that
    repeat an id are ordered by a hash of their texts, by which the ranges may also split them. A null text counts
    as empty: end_id alone. An empty table gives an empty file set. Other columns of `docs` are not read.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    ranged = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    options = {"compress": "ZSTD", "bloom.filter.columns": "doc_id", "bloom.filter.fpp": "0.01", "create.index": "true", "row.index.stride": index_stride, "stripe.size": stripe_bytes}
    tokenize(ranged, tokenizer, end_id=end_id, keeps_spaces=keeps_spaces).withColumn("part", F.spark_partition_id()).write.options(**{f"orc.{k}": v for k, v in options.items()}).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list | None = None, id_type: str = "bigint") -> DataFrame:
    """The written rows; with doc_ids, only theirs, found by the files' figures and Bloom filters."""
    df = spark.read.schema(f"doc_id {id_type}, start bigint, n_tokens bigint, ids array<int>, part int").orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def document_spans(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids).

    Python sees the ids once, a batch at a time. The sums by which starts in a file are shifted come from the
    narrow columns alone and have one row for each file.
    """
    schema = T.StructType([T.StructField("doc_id", tokens.schema["doc_id"].dataType), T.StructField("part", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            doc_id, part, start, lists = batch.columns
            ends = np.asarray(lists.offsets)
            flat = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([doc_id, part, start, pa.array(np.diff(ends).astype("i8")), pa.array(crcs, pa.int64())], schema=arrow)

    files = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rows = tokens.select("doc_id", "part", "start", "ids").mapInArrow(run, schema)
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
