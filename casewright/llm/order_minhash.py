"""Order MinHash fingerprints of documents.

A text's k-mers of code points are numbered by occurrence, so that equal ones differ, and hashed. Each of
BUCKETS equal ranges of the hashes keeps its least two numbered k-mers; these are put back into text order and
hashed as a tuple. Two texts agree in a bucket if both k-mers and their order agree, so the share of equal
buckets follows edit distance, not just common content. All buckets share one hash, so the work is linear in
the text (and two sorts), whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

K = 5
BUCKETS = 64
TUPLE = 2
_PLACE_BITS = 24
_EMPTY = "...."


def sketch(text: str | None):
    """BUCKETS values of 16 bits, or -1 where no k-mer fell; a text shorter than K is one k-mer, an empty one none."""
    import numpy as np

    one = np.uint64

    def mix(x):
        x = (x ^ (x >> one(30))) * one(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> one(27))) * one(0x94D049BB133111EB)
        return x ^ (x >> one(31))

    def ordered(h):
        """Hashes without their lower bits in ascending order, equal ones in text order, and their places."""
        if len(h) < 1 << _PLACE_BITS:
            packed = np.sort((h >> one(_PLACE_BITS) << one(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64))
            return packed >> one(_PLACE_BITS), (packed & one((1 << _PLACE_BITS) - 1)).astype(np.int64)
        top = h >> one(_PLACE_BITS)
        place = np.argsort(top, kind="stable")
        return top[place], place

    out = np.full(BUCKETS, -1, np.int64)
    if not text:
        return out
    codes = np.frombuffer(text.ljust(K, "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes) - K + 1
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = h * one(0x9E3779B97F4A7C15) + codes[j : n + j]
    kmers, place = ordered(mix(h))
    index = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = kmers[1:] != kmers[:-1]
    occurrence = index - np.maximum.accumulate(np.where(fresh, index, 0))
    numbered = np.empty(n, np.uint64)
    numbered[place] = mix(kmers * one(0xD6E8FEB86659FD93) + occurrence.astype(np.uint64))
    least, where = ordered(numbered)
    width = 64 - _PLACE_BITS
    starts = np.searchsorted(least, np.arange(BUCKETS + 1, dtype=np.uint64) * one((1 << width) // BUCKETS))
    for b in range(BUCKETS):
        a, z = starts[b], starts[b + 1]
        if a < z:
            chosen = sorted(zip(where[a : min(z, a + TUPLE)].tolist(), least[a : min(z, a + TUPLE)].tolist()))
            value = b + 1
            for _, x in chosen:
                value = (value * 0x9E3779B97F4A7C15 + x) & (1 << 64) - 1
                value ^= value >> 29
            value = (value * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
            out[b] = value >> 48
    return out


def written(values) -> str:
    """Four hexadecimal digits for each bucket, dots for an empty one."""
    return "".join(_EMPTY if v < 0 else f"{v:04x}" for v in values.tolist())


def likeness(a, b) -> float:
    """Share of equal buckets of those that either sketch fills; 1 for two empty ones."""
    used = (a >= 0) | (b >= 0)
    total = int(used.sum())
    return float((used & (a == b)).sum()) / total if total else 1.0


def edited(text: str, following: str) -> str:
    """The text, its last third (rounded down) replaced by as much of the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_FIELDS = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _with_neighbours(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """Rows dealt to ranges of descending ids, each range followed by a copy of the first row of the next (guest)."""
    order = F.struct("doc_id", "tie")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # One row with `partitions` bounds at most.
    bounds = base.agg(F.percentile_approx("doc_id", [k / partitions for k in range(1, partitions)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    n = len(bounds) + 1
    of = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    ranged = base.withColumn("range", F.coalesce(F.when(F.col("doc_id").isNotNull(), of), F.lit(0)))
    # One row for each range: its first in descending order.
    heads = sorted(((r["range"], r["head"]) for r in ranged.groupBy("range").agg(F.max(order).alias("head")).collect()), reverse=True)
    guests = [(h["doc_id"], h["tie"], heads[k - 1][0]) for k, (_, h) in enumerate(heads)]
    if not guests:
        return ranged.withColumn("guest", F.lit(False))
    schema = T.StructType([T.StructField("g_id", base.schema["doc_id"].dataType), T.StructField("g_tie", T.LongType()), T.StructField("g_range", T.IntegerType())])
    known = docs.sparkSession.createDataFrame(guests, schema)
    ids = [g[0] for g in guests if g[0] is not None]
    first = base.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")))
    first = first.select("doc_id", "text", "tie", F.col("g_range").alias("range"), F.lit(True).alias("guest"))
    rows = ranged.withColumn("guest", F.lit(False)).union(first)
    return rows.repartitionById(n, F.col("range")).sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


def order_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row for each row.

    The next document is the one before it in ids, and the greatest after the least; null ids come after all
    others, rows of one id by a hash of their texts. Null texts count as empty. A lone document follows itself.
    Ids are whole numbers. Texts cross the network once. Other columns aren't read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(*f) for f in _FIELDS)])
    rows = _with_neighbours(docs, id_col, text_col, max(1, shuffle_partitions(docs.sparkSession)))

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, closed = to_arrow_schema(schema), None, False
        for batch in batches:
            out = []
            for key, text, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if closed:
                    continue
                text = text.as_py()
                now = (key, text, sketch(text))
                if held:
                    k, t, s = held
                    e = edited(t, text)
                    es = sketch(e) if e != t else s
                    out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), written(s), written(es), likeness(s, es), likeness(s, now[2])))
                held, closed = now, guest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.select("doc_id", "text", "guest").mapInArrow(run, schema)
