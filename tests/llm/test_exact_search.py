import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm import exact_search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("score", T.StringType()), T.StructField("i", T.IntegerType())])


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def plainly(rows, k):
    used = {(i, tuple(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, v, [math.floor(64 * x) for x in v]) for i, v in used]
    out = []
    for i, v, q in whole:
        if i is None or i % 20:
            continue
        scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c)))), j is None, j) for j, w, c in whole if (j, w) != (i, v)]
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df, wanted=None, **kw):
    return sorted((tuple(r) for r in exact_search.exact_top_k(df, F.col("vec_id") % 20 == 0 if wanted is None else wanted, **kw).collect()), key=str)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_equals_brute_force(spark, block):
    r = random.Random(block)
    rows = [(k, [r.choice([0.0, 0.0, r.uniform(-1, 1)]) for _ in range(8)]) for k in range(400)]
    rows += [(k, [0.5] * 8) for k in range(400, 480)]  # ties everywhere
    assert found(table_of(spark, rows), k=20, block=block) == plainly(rows, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [1.0, inf]), (100, []), (None, [3.0, 3.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0]), (5, [-0.0, 0.0]), (120, [0.001, -0.001])]
    assert found(table_of(spark, rows), k=3) == plainly(rows, 3)
    assert found(table_of(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>")), k=50) == plainly([(i, v if v is None else [x if x not in (0.001, -0.001) else x for x in v]) for i, v in rows], 50)


def test_large_numbers_stay_whole(spark):
    rows = [(20 * k, [2.0**e, -(2.0**e), 3.0]) for k, e in enumerate((0, 20, 24, 30, 40, 50, 70))]
    assert found(table_of(spark, rows), k=20) == plainly(rows, 20)


def test_few_and_no_rows(spark):
    assert found(table_of(spark, [(20, [1.0])])) == []
    assert found(table_of(spark, [(20, [1.0]), (21, [1.0])])) == [(20, 1, 21, 4096)]
    assert found(table_of(spark, [(21, [1.0]), (22, [1.0])])) == []
    assert found(table_of(spark, [(21, [1.0])]).where("false")) == []
    assert found(table_of(spark, [(20, None)])) == []


def test_a_common_vector_is_one_of_many(spark):
    rows = [(k, [1.0, 0.5]) for k in range(1500)] + [(k, [1.0, 0.25]) for k in range(1500, 1600)]
    assert found(table_of(spark, rows), k=20, block=256) == plainly(rows, 20)
