"""The checklist analysis against brute force: own searches and limits, reranking, parameters without hits, full scans."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from casewright.functions import answers
from casewright.operators import chunks, extraction, report, retrieval
from casewright.plans import registry

SF_DIR = "/root/testdata/sf0.001"

#: application_id, document_id, chunk_index, text; document 9 of case 3 has no vector, case 4 no chunks.
CHUNKS = [(1, d, i, t) for d, ts in ((1, ("red pipe here", "blue", "Red valve")), (2, ("valve red", "pipe", "pipe red")), (3, ("green", "green pipe", "blue pipe red"))) for i, t in enumerate(ts)] + [(2, 5, 0, "blue only"), (2, 5, 1, "valve"), (3, 9, 0, "late red pipe")]
VECTORS = {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [0.0, 1.0], 5: [0.8, 0.6]}
QUERIES = {"red pipe": [0.8, 0.6], "blue": [0.0, 1.0], "a green pipe of more than twenty": [1.0, 0.0], "none": [1.0, 0.0]}


def bm25(case, query):
    """{(document, chunk): normalised BM25} of a case's chunks that have a vector."""
    own = {(d, i): re.findall(r"\w+", t.lower()) for a, d, i, t in CHUNKS if a == case and d in VECTORS}
    if not own:
        return {}
    mean, idf = sum(map(len, own.values())) / len(own), {}
    for t in set(query.split(" ")):
        df = sum(t in ts for ts in own.values())
        idf[t] = math.log((len(own) - df + 0.5) / (df + 0.5) + 1)
    most = 2.2 * sum(idf.values())
    return {k: sum(v * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for t, v in idf.items()) / most for k, ts in own.items()}


def search(case, query, limit, rerank):
    rows, texts = [], bm25(case, query)
    for a, d, i, t in CHUNKS:
        if a == case and d in VECTORS:
            s, share = sum(x * y for x, y in zip(VECTORS[d], QUERIES[query])), round(texts[d, i], 9)
            rows.append((round((0.5 * s + 0.5 * share) if len(query) < 20 else s, 9), share, d, i, t))
    rows.sort(key=lambda r: (-r[0], r[2], r[3]))
    if rerank:
        rows = sorted(rows[:rerank], key=lambda r: (-round(r[1] + r[0] / 10, 9), r[2], r[3]))
    return [r[4] for r in rows[:limit]]


def asked():
    out = []
    for case in (1, 2, 3, 4):
        for q in QUERIES:
            for limit in (1, 4, 8):
                for rerank in (0, 2, 5):
                    for scan in (True, False):
                        for word in (q.split(" ")[0], "late"):
                            out.append((case, len(out), q, limit, rerank, scan, word))
    return out


def frames(spark):
    c = spark.createDataFrame([(*r, len(r[3])) for r in CHUNKS], "application_id int, document_id bigint, chunk_index int, text string, content_length int")
    v = spark.createDataFrame([(k, x) for k, x in VECTORS.items()], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame(list(QUERIES.items()), "query string, vector array<double>")
    p = spark.createDataFrame(asked(), "application_id int, parameter_id bigint, query string, search_limit int, rerank_limit int, use_full_scan boolean, word string")
    return c, v, q, p


def test_every_parameter_is_searched_answered_and_scanned(spark):
    c, v, q, p = frames(spark)
    hits = retrieval.search_each(c, v, q, p.select(retrieval.SEARCH).distinct())
    found = {}
    for r in sorted(hits.collect(), key=lambda r: r.position):
        found.setdefault((r.application_id, r.query, r.search_limit, r.rerank_limit), []).append(r.text)
    for case, _, query, limit, rerank, _, _ in asked():
        assert found.get((case, query, limit, rerank), []) == search(case, query, limit, rerank)

    packed = chunks.pack_batches(chunks.usable(c), 20).join(c.select("document_id", "chunk_index", "text"), ["document_id", "chunk_index"])
    batches = packed.groupBy("application_id", "batch_index").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("document_id", "chunk_index", "text"))), lambda x: x["text"]), " ").alias("text"))
    lots = {}
    for r in sorted(batches.collect(), key=lambda r: r.batch_index):
        lots.setdefault(r.application_id, []).append((r.n_chunks, r.text))
    got = {r.parameter_id: (r.application_id, r.value, round(r.confidence, 4), r.chunks_scanned) for r in extraction.run_checklists(p, hits, batches, retrieval.SEARCH).collect()}
    assert len(got) == len(asked())
    for case, k, query, limit, rerank, scan, word in asked():
        piece = next((t[t.lower().index(word) :][:40] for t in search(case, query, limit, rerank) if word in t.lower()), None)
        if piece is not None or not scan:
            want = (piece or answers.NOT_FOUND, 0.8 if piece else 0.1, None)
        else:
            read = 0
            for n, text in lots.get(case, []):
                read += n
                if word in text.lower():
                    want = (text[text.lower().index(word) :][:40], 0.9, read)
                    break
            else:
                want = (f"Информация не найдена по всем {read} чанкам", 0.1, read)
        assert got[k] == (case, *want)


def test_results_of_every_case(spark):
    links = [(a, b) for a in range(1, 5) for b in (1, 2) if (a, b) != (4, 2)]
    parameters = [(b * 10 + i, b, f"p{i}", i) for b in (1, 2) for i in range(3)]
    results = [(a, k, f"v{a}-{k}", 0.5) for a in (1, 3) for k in (10, 21)]
    df = report.results_by_checklist(spark.createDataFrame(links, "application_id bigint, checklist_id bigint"), spark.createDataFrame(parameters, "id bigint, checklist_id bigint, name string, order_index int"), spark.createDataFrame(results, "application_id bigint, parameter_id bigint, value string, confidence double"))
    kept = {(a, k): v for a, k, v, _ in results}
    want = {(a, b, k): kept.get((a, k)) for a, b in links for k, of, *_ in parameters if of == b}
    got = [((r.application_id, r.checklist_id, r.parameter_id), r.value) for r in df.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_first_of_repeated_results(spark):
    rows = [(5, 1, 10, "b", 0.5), (3, 1, 10, "c", None), (9, 1, 10, "a", 0.1), (4, 1, None, None, 0.2), (6, 1, None, "x", 0.3)]
    df = spark.createDataFrame(rows, "id bigint, application_id bigint, parameter_id bigint, value string, confidence double")
    by_id = {(r.application_id, r.parameter_id): (r.id, r.value) for r in report.first_results(df).collect()}
    assert by_id == {(1, 10): (3, "c"), (1, None): (4, None)}
    by_value = {(r.application_id, r.parameter_id): r.value for r in report.first_results(df.drop("id")).collect()}
    assert by_value == {(1, 10): "a", (1, None): None}
    assert report.first_results(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
def test_queries_answer_every_parameter_and_case(spark):
    from casewright.sources.relations import load

    p, links = load(spark, SF_DIR, "checklist_parameters"), load(spark, SF_DIR, "application_checklists")
    n = p.count()
    got = registry.QUERIES["checklist_analysis"](spark, SF_DIR)
    assert got.count() == got.select("parameter_id").distinct().count() == n
    assert registry.QUERIES["results_by_checklist_all"](spark, SF_DIR).count() == links.join(p, "checklist_id").count()


def test_results_of_links_are_not_shuffled_by_parameter(spark):
    links = spark.range(40).select((F.col("id") % 20).alias("application_id"), F.floor(F.col("id") / 20).alias("checklist_id"))
    parameters = spark.range(1000).select("id", F.floor(F.col("id") / 500).alias("checklist_id"), F.lit("p").alias("name"), (F.col("id") % 500).cast("int").alias("order_index"))
    results = links.select("application_id", (F.col("checklist_id") * 500 + F.col("application_id")).alias("parameter_id"), F.lit("v").alias("value"), F.lit(0.5).alias("confidence"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = report.results_by_checklist(links, parameters, results)
        assert df.count() == 20_000 and df.where("value = 'v'").count() == 40
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The join that multiplies rows, by checklist, is the last: nothing is dealt out by parameter after it.
    assert "checklist_id" in (last := plan[plan.index("SortMergeJoin") :].split("]")[0]) and "parameter_id" not in last


def test_partial_results_of_an_id_that_two_checklists_have(spark):
    links = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1)], "application_id bigint, checklist_id bigint")
    parameters = spark.createDataFrame([(7, 1, "a", 0), (7, 2, "b", 0), (8, 2, "c", 1)], "id bigint, checklist_id bigint, name string, order_index int")
    results = spark.createDataFrame([(1, 1, 7, "x"), (2, 2, 7, "x"), (3, 2, 8, "y"), (4, 3, 7, "z"), (5, 3, 8, "no link")], "id bigint, application_id bigint, parameter_id bigint, value string")
    got = sorted(tuple(r) for r in report.partial_results(links, parameters, results).collect())
    assert got == [(1, 1, 1, 1), (1, 2, 1, 2), (2, 2, 2, 2), (3, 1, 1, 1)]


def test_added_links_are_dealt_out_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    from casewright.operators import mutations
    from casewright.sources import partitions

    links = spark.createDataFrame([(a, c) for a in range(50) for c in range(a % 7)], "application_id bigint, checklist_id bigint")
    links.write.parquet(str(tmp_path / "links"))
    links = spark.read.parquet(str(tmp_path / "links"))
    monkeypatch.setattr(partitions, "PART", 100)
    df = mutations.add_checklists(links, links.select("application_id", (F.col("checklist_id") + 1).alias("checklist_id")))
    assert df.rdd.getNumPartitions() == partitions.parts(links) > 4
    assert sorted(tuple(r) for r in df.collect()) == [(a, c) for a in range(50) for c in range(a % 7 + 1) if a % 7]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
def test_the_analysis_deals_lines_out_once(spark):
    """What it returns is made from its parameters as they were written once, not from the lines again."""
    assert not any("lineitem" in f for f in registry.QUERIES["checklist_analysis"](spark, SF_DIR).inputFiles())


def test_links_of_one_checklist_meet_its_parameters_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(report, "SLICE", 10)
    monkeypatch.setattr(report, "PIECE", 4)
    links = [(a, 1) for a in range(60)] + [(a, 2) for a in range(5)] + [(1, 3)]
    parameters = [(b * 100 + i, b, f"p{i}", i) for b in (1, 2) for i in range(11)] + [(205, 1, "shared", None)]
    results = [(a * 100 + k, a, k, f"v{a}-{k}", 0.5) for a in range(0, 70, 3) for k in (101, 108, 205)] + [(1, 0, 101, "first", None)]
    frames = (spark.createDataFrame(links, "application_id bigint, checklist_id bigint"), spark.createDataFrame(parameters, "id bigint, checklist_id bigint, name string, order_index int"), spark.createDataFrame(results, "id bigint, application_id bigint, parameter_id bigint, value string, confidence double"))
    kept = {(a, k): (v, c) for _, a, k, v, c in results}
    want = sorted((a, k, b, name, str(i), *map(str, kept.get((a, k), (None, None)))) for a, b in links for k, of, name, i in parameters if of == b)
    df = report.results_of_all_links(*frames)
    got = [(r.application_id, r.parameter_id, r.checklist_id, r.parameter, str(r.order_index), str(r.value), str(r.confidence)) for r in df.collect()]
    assert sorted(got) == want
    assert df.where("checklist_id = 1").select(F.spark_partition_id()).distinct().count() > 1
    again = report.results_by_checklist(*frames)
    assert again.columns == df.columns and again.exceptAll(df).count() == df.exceptAll(again).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")
def test_results_of_all_cases_are_made_in_many_tasks_from_arrays(spark):
    df = registry.QUERIES["results_by_checklist_all"](spark, SF_DIR)
    assert "Generate inline" in df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
