"""Exact top-k by inner product of whole-number vectors, term at a time.

Vectors are sparse rows of (component, weight). A block of candidates is turned into postings, for each component the
candidates that have it and their weights; each query of a block of queries adds its weight times those of a
component's postings into one dense array of scores, component after component. The best k of that array are
selected by partition, and the selections of all blocks are merged by rank. Nothing is skipped, so the result is
exact. Blocks of queries meet blocks of candidates of a bounded size, each pair in a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 64
#: Rows of a block of candidates or queries, on average.
BLOCK = 4096
#: Postings that leave out fewer candidates than one in so many are read as a whole, zeros and all.
_DENSE = 3


def finite(vector: Column) -> Column:
    """Not null, and neither is any component, nor infinite or not a number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vectors, scale: int):
    """floor(scale * x) of rows of different lengths as a matrix, short ones filled up with zeros; exact at any size."""
    import numpy as np

    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(float))
    large = bool(len(flat)) and np.abs(flat).max() * np.abs(flat).max() * max(1, sizes.max()) >= 2.0**62
    out = np.zeros((len(sizes), sizes.max(initial=0)), object if large else np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = [int(x) for x in flat] if large else flat
    return out


def postings(block):
    """For each component: the candidates with a weight other than 0, or a slice of all where few lack it, and the weights."""
    import numpy as np

    for column in block.T:
        at = np.flatnonzero(column)
        yield (at, column[at]) if _DENSE * len(at) < (_DENSE - 1) * len(column) else (slice(None), np.ascontiguousarray(column))


def accumulated(query, lists, size: int, kind):
    """Scores of all candidates of a block, by scattering the postings of the query's components."""
    import numpy as np

    scores = np.zeros(size, kind)
    for weight, (at, weights) in zip(query, lists):
        if weight:
            scores[at] += weight * weights
    return scores


def selected(scores, k: int):
    """Places of the k highest scores in order, ties by place."""
    import numpy as np

    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        places = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, -scores[places]))]


def exact_top_k(rows: DataFrame, wanted: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row where `wanted` holds.

    Scores are inner products of floor(scale * x), in whole numbers; what a long can't hold counts as its nearest end.
    Ties go to the smaller id, nulls last. Vectors that are null or hold null or non-finite components take no part;
    of two lengths, the shorter is filled up with zeros. Rows that repeat an id and a vector are one; rows that share
    an id only are searched for and found apart. Other columns aren't read. An empty table, or one without wanted
    rows, gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "search")
    narrow = rows.where(finite(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(wanted, F.lit(False)).alias("wanted"))
    found = scratch.put(narrow.withColumn("mark", F.xxhash64("vector")).dropDuplicates(["vec_id", "mark"]))
    sizes = found.agg(F.count("*"), F.count_if("wanted")).first()
    n_columns, n_rows = (max(1, -(-n // block)) for n in sizes)
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", "mark", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = found.where("wanted").select("vec_id", "mark", "vector", dealt(n_rows, 1).alias("i"), every(n_columns).alias("j"))
    candidates = found.select("vec_id", "mark", "vector", every(n_rows).alias("i"), dealt(n_columns, 2).alias("j"))

    def search(asked, held):
        import numpy as np
        import pyarrow as pa

        if not asked.num_rows or not held.num_rows:
            return out_schema.empty_table()
        held = held.sort_by([("vec_id", "ascending"), ("mark", "ascending")])  # nulls go last
        queries, weights = (whole_numbers(t["vector"].combine_chunks(), scale) for t in (asked, held))
        width = min(queries.shape[1], weights.shape[1])
        most = [int(abs(m).max()) if m.size else 0 for m in (queries, weights)]
        bound = most[0] * most[1] * max(1, width)
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
        lists, size = list(postings(weights[:, :width].astype(kind))), held.num_rows
        ids, marks = held["vec_id"], held["mark"].to_numpy()
        own = {key: place for place, key in enumerate(zip(ids.to_pylist(), marks.tolist()))}
        which, places, scores = [], [], []
        for n, key in enumerate(zip(asked["vec_id"].to_pylist(), asked["mark"].to_pylist())):
            got = accumulated(queries[n, :width].astype(kind), lists, size, kind)
            got = np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in got], np.int64) if kind is object else got
            best = selected(got.astype(np.int64), k + 1)
            best = best[best != own.get(key, -1)][:k]
            which.append(np.full(len(best), n))
            places.append(best)
            scores.append(got[best].astype(np.int64))
        which, places = np.concatenate(which), np.concatenate(places)
        return pa.table([asked["vec_id"].take(pa.array(which)), asked["mark"].take(pa.array(which)), ids.take(pa.array(places)), pa.array(np.concatenate(scores))], schema=out_schema)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = found.schema["vec_id"].dataType
    out_schema = pa.schema([("query_id", to_arrow_type(id_type)), ("query_mark", pa.int64()), ("vec_id", to_arrow_type(id_type)), ("score", pa.int64())])
    schema = f"query_id {id_type.simpleString()}, query_mark bigint, vec_id {id_type.simpleString()}, score bigint"
    best = queries.groupBy("i", "j").cogroup(candidates.groupBy("i", "j")).applyInArrow(lambda asked, held: search(asked, held), schema)
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
