"""Vector and text indexes against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casewright.operators.text_index import TextIndex
from casewright.operators.vector_index import VectorIndex, fit_centroids

VECTORS = "application_id int, document_id bigint, vector array<float>"
CHUNKS = "application_id int, document_id bigint, chunk_index int, text string"


def spread(r, n, size=8):
    """Vectors around a few directions, of different lengths, with equal ones among them."""
    middles = [[r.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    out = [[m + r.gauss(0, 0.25) for m in r.choice(middles)] for _ in range(n)]
    return [[float(f"{x:.4f}") for x in (out[0] if i % 50 == 7 else v)] for i, v in enumerate(out)]


def best(rows, case, q, k):
    scored = [(-sum(a * b for a, b in zip(v, q)), d) for c, d, v in rows if c == case]
    return [d for _, d in sorted(scored)[:k]]


def test_exact_search_equals_brute_force_and_probing_recalls(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, v) for i, v in enumerate(spread(r, 1500))]
    queries = [(c, f"q{i}", v) for c in (1, 2, 3, 9) for i, v in enumerate(spread(r, 12))]
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS.replace("float", "double")).repartition(5), str(tmp_path / "index"), n=24)
    asked = spark.createDataFrame(queries, "application_id int, query string, vector array<double>")

    def found(**how):
        out = {}
        for x in sorted(index.search(asked, 10, **how).collect(), key=lambda x: x.position):
            out.setdefault((x.application_id, x.query), []).append(x.document_id)
        return out

    want = {(c, q): w for c, q, v in queries if (w := best(rows, c, v, 10))}
    assert found() == want == found(probes=1)
    near = found(exact=False, probes=6)
    assert sum(len(set(near[k]) & set(w)) for k, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_exact_search_skips_lists(spark, tmp_path):
    r = random.Random(4)
    rows = [(1, i, [10.0 * math.cos(i % 12) + r.gauss(0, 0.01), 10.0 * math.sin(i % 12) + r.gauss(0, 0.01)]) for i in range(600)]
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS), str(tmp_path / "index"), n=12)
    read = []
    whole = index._scored
    index._scored = lambda probes: (read.append(probes.count()), whole(probes))[1]
    got = index.search(spark.createDataFrame([(1, "q", [1.0, 0.0])], "application_id int, query string, vector array<double>"), 5, probes=2).collect()
    assert len(got) == 5 and read == [2, 0]


def test_empty_index_and_few_vectors(spark, tmp_path):
    asked = spark.createDataFrame([(1, "q", [1.0, 0.0])], "application_id int, query string, vector array<double>")
    assert VectorIndex.build(spark.createDataFrame([], VECTORS), str(tmp_path / "none")).search(asked, 5).count() == 0
    few = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (2, 3, [1.0, 0.0])], VECTORS)
    assert len(fit_centroids(few)) == 1
    assert [(r.document_id, r.position) for r in VectorIndex.build(few, str(tmp_path / "few")).search(asked, 5).orderBy("position").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("written", [False, True])
def test_bm25_equals_its_formula(spark, tmp_path, written):
    r = random.Random(5)
    words = ["Pipe", "pipe", "valve", "Über", "x1", "日本", "the", "the", "the"]
    rows = [(r.choice([1, 2]), d, i, " ".join(r.choice(words) for _ in range(r.randrange(12))) + "," * r.randrange(2)) for d in range(30) for i in range(3)] + [(3, 99, 0, None), (3, 98, 0, "")]
    index = TextIndex.build(spark.createDataFrame(rows, CHUNKS).repartition(3))
    index = index.write(str(tmp_path / "text")) if written else index
    asked = [(c, q) for c in (1, 2, 3, 7) for q in ("Pipe the the", "über, 日本", "none such", "", "the nowhere")]
    got = {(x.application_id, x.query, x.document_id, x.chunk_index): x.text_score for x in index.scores(spark.createDataFrame(asked, "application_id int, query string")).collect()}
    want = {}
    for case, query in asked:
        own = {(d, i): Counter(re.findall(r"[^\W_]+", (t or "").lower())) for c, d, i, t in rows if c == case}
        terms = set(re.findall(r"[^\W_]+", query.lower()))
        if not own or not terms:
            continue
        mean = sum(c.total() for c in own.values()) / len(own)
        idf = {t: math.log(1 + (len(own) - (df := sum(t in c for c in own.values())) + 0.5) / (df + 0.5)) for t in terms}
        for (d, i), c in own.items():
            if terms & c.keys():
                want[case, query, d, i] = sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t in terms) / (2.2 * sum(idf.values()))
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-8 for k, w in want.items()) and max(want.values()) < 1


def test_no_plan_joins_chunks_with_queries(spark):
    """The analysis' searches meet vectors by case and list and texts by case and term, never by the case alone."""
    from casewright.operators import retrieval

    c = spark.createDataFrame([(1, 1, 0, "a b"), (1, 2, 0, "b c")], CHUNKS)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query string, vector array<double>")
    s = spark.createDataFrame([(1, "a", 2, 0)], "application_id int, query string, search_limit int, rerank_limit int")
    lines = retrieval.search_each(c, v, q, s)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    alone = [i for i, x in enumerate(lines) if re.search(r"Join \w+, \(application_id#\d+ = application_id#\d+\)", x)]
    for i in alone:  # a query's case gives it the bounds of the case's lists, a bounded number
        below = next((k for k in range(i + 1, len(lines)) if depth(lines[k]) <= depth(lines[i])), len(lines))
        assert any("radius" in x for x in lines[i:below])
    assert sum("Join" in x for x in lines) > len(alone)


def test_postings_are_dealt_out_once(spark):
    rows = [(1, 1, 0, "a b a"), (1, 1, 0, "c a b"), (1, 2, 0, None), (2, 3, 1, "")]
    postings = TextIndex.build(spark.createDataFrame(rows, CHUNKS)).postings
    got = sorted((r.application_id, r.document_id, r.chunk_index, r.size, r.term, r.n) for r in postings.collect())
    assert got == [(1, 1, 0, 3, "a", 3), (1, 1, 0, 3, "b", 2), (1, 1, 0, 3, "c", 1)]
    frequencies = TextIndex.build(spark.createDataFrame(rows, CHUNKS)).frequencies
    assert frequencies._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_an_index_for_known_queries_holds_their_terms(spark, monkeypatch):
    """Postings of other terms are left out before they are shuffled, and scores stay the same; with too many terms none is left out."""
    from casewright.operators import text_index

    rows = [(1, d, i, f"a b {'a ' * d} c{i} d{d}") for d in range(4) for i in range(3)] + [(2, 9, 0, "b z"), (3, 8, 0, None)]
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(3)
    queries = spark.createDataFrame([(1, "a c1 a"), (1, "nowhere"), (2, "a"), (2, "z y"), (3, "b"), (4, "a")], "application_id int, query string")
    want = sorted(map(tuple, TextIndex.build(chunks).scores(queries).collect()))
    index = TextIndex.build(chunks, queries)
    assert {(r.application_id, r.term) for r in index.postings.collect()} == {(1, "a"), (1, "c1"), (2, "z")}
    assert want and sorted(map(tuple, index.scores(queries).collect())) == want
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("LeftSemi")  # the join stands below the exchange
    monkeypatch.setattr(text_index, "ASKED", 2)
    index = TextIndex.build(chunks, queries)
    assert (1, "b") in {(r.application_id, r.term) for r in index.postings.collect()}
    assert sorted(map(tuple, index.scores(queries).collect())) == want


def test_few_terms_go_to_the_postings(spark, tmp_path, monkeypatch):
    """Postings and frequencies stay where they are if few terms are asked; with many they are dealt out, and scores are the same, also of repeated, empty and null rows."""
    from casewright.operators import text_index

    rows = [(1, d, i, f"a b {'a ' * d} c{i} d{d}") for d in range(4) for i in range(3)] + [(1, 0, 0, "a b  c0 d0"), (2, 9, 0, "b z"), (3, 8, 0, None), (3, None, None, "b"), (None, 7, 0, "a")]
    queries = spark.createDataFrame([(1, "a c1 a"), (1, "nowhere"), (2, "a"), (2, "z y"), (3, "b"), (3, None), (4, "a"), (None, "a")], "application_id int, query string")
    index = TextIndex.build(spark.createDataFrame(rows, CHUNKS).repartition(3)).write(str(tmp_path / "text"))

    def joined(scores, column):
        """The operators between the scans of a column and the next join, and that join."""
        lines, out = scores._jdf.queryExecution().executedPlan().toString().split("\n"), []
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        for i, line in enumerate(lines):
            if "FileScan" in line and f"{column}#" in line:
                at = depth(line)
                for above in reversed(lines[:i]):
                    if depth(above) < at:
                        at = depth(above)
                        out.append(above[at:].split("(")[0].split()[0])
                        if "Join" in above:
                            break
        return out

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = index.scores(queries)
        for column in ("size", "df"):
            assert "BroadcastHashJoin" in joined(scores, column) and not {"Exchange", "SortMergeJoin"} & {*joined(scores, column)}
        got = sorted(map(tuple, scores.select("application_id", "query", F.coalesce("document_id", F.lit(-1)), F.coalesce("chunk_index", F.lit(-1)), "text_score").collect()))
        assert {r[2] for r in got if r[0] == 3} == {-1} and not any(r[0] is None for r in got)
        monkeypatch.setattr(text_index, "ASKED", 2)
        scores = index.scores(queries)
        assert {"Exchange", "SortMergeJoin"} <= {*joined(scores, "size")}
        assert got == sorted(map(tuple, scores.select("application_id", "query", F.coalesce("document_id", F.lit(-1)), F.coalesce("chunk_index", F.lit(-1)), "text_score").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_common_term_is_written_by_several_tasks(spark, tmp_path):
    """Files hold ranges of case and term in order, one term's postings more than one file's; rows of one chunk are added up, also null ones."""
    rows = [(1, d, 0, "the" if d else "the a") for d in range(2000)] + [(1, 5, 0, "the"), (1, 5, 0, "the the"), (1, None, 0, "x x"), (1, None, 0, "x y"), (None, 3, None, "z"), (None, 3, None, "z"), (2, 1, 0, ""), (2, 1, 1, None)]
    index = TextIndex.build(spark.createDataFrame(rows, CHUNKS).repartition(3))
    kinds = index.postings.dtypes
    plain = lambda df: sorted(map(str, df.select("application_id", "document_id", "chunk_index", "size", "term", "n").collect()))
    want = plain(index.postings)
    index = index.write(str(tmp_path / "text"))
    assert index.postings.dtypes == kinds and plain(index.postings) == want and len(want) == 2005
    told = {(r.document_id, r.size, r.term): r.n for r in index.postings.where("document_id IS NULL OR document_id IN (3, 5)").collect()}
    assert told == {(3, 1, "the"): 1, (3, 1, "z"): 2, (5, 1, "the"): 2, (5, 2, "the"): 2, (None, 2, "x"): 3, (None, 2, "y"): 1}
    files = {}
    for r in index.postings.select("application_id", "term", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")).orderBy("place").collect():
        files.setdefault(r.file, []).append((r.application_id or 0, r.term))
    assert all(x == sorted(x) for x in files.values())
    assert sum((1, "the") in x for x in files.values()) > 1
    ranges = sorted((x[0], x[-1]) for x in files.values())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_few_large_tasks_deal_their_texts_out(spark, tmp_path):
    """Where few tasks read texts whose postings go to many, texts are dealt out before they are counted; the index is the same, also of repeated, empty and null rows."""
    rows = [(1, d, i, f"a b {'a ' * d} c{i}") for d in range(9) for i in range(3)] + [(1, 0, 0, "a  b c0"), (1, None, 0, "x x"), (1, None, 0, "x y"), (None, 3, None, "z"), (None, 3, None, "z"), (2, 1, 0, ""), (2, 1, 1, None)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    plain = lambda df: sorted(map(str, df.collect()))
    plan = lambda index: index.counted[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        one, many = TextIndex.build(chunks.coalesce(1)), TextIndex.build(chunks.coalesce(4))
        assert "Exchange hashpartitioning(application_id" in plan(one) and "Exchange" not in plan(many)
        one, many = (index.write(str(tmp_path / name)) for index, name in ((one, "one"), (many, "many")))
        assert plain(one.postings) == plain(many.postings) and plain(one.frequencies) == plain(many.frequencies) and plain(one.cases) == plain(many.cases)
        assert one.postings.where("term = 'x'").first().n == 3 and one.postings.where("application_id IS NULL").first().n == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
