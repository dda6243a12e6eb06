"""Operators and functions on small fixtures: edge cases that the driver's tables don't hold."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from casewright.functions import answers, display, timefmt
from casewright.operators import access, chunks, context, mutations, report, retrieval, status
from casewright.streaming import progress


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# Answers


@pytest.mark.parametrize(
    "response, query, value, confidence, kind",
    [
        (None, "q", answers.NOT_FOUND, 0.0, "empty"),
        ("", "q", answers.NOT_FOUND, 0.0, "empty"),
        ("  ", "q", "", 0.7 + 0.1, "plain_text"),
        ("Нет данных о сроках", "срок", answers.NOT_FOUND, 0.1, "not_found"),
        ('{"value": 5, "confidence": 0.4, "page": 3}', "q", "5", 0.4, "json"),
        ('{"result": true}', "q", "True", 0.9, "json"),
        ('{"a": 1, "Срок": "10 дней"}', "срок поставки", "10 дней", 0.85, "json"),
        ('{"a": null}', "q", "None", 0.8, "json"),
        ("[1.5]", "q", "1.5", 0.8, "json_array"),
        ('см. ```json\n{"value": "x"}\n``` конец', "q", "x", 0.9, "json_block"),
        ("РЕЗУЛЬТАТ: 12 %\nещё", "q", "12 %", 0.9, "result_prefix"),
        ("Цена договора: 100\nСрок: 5", "цена договора", "100", 0.95, "key_value_exact"),
        ("Общая цена: 100\nСрок: 5", "цена договора", "100", 0.85, "key_value_partial"),
        ("Итого: 7", "площадь", "7", 0.75, "key_value_single"),
        ("- площадь 5 м\n- высота 3 м", "площадь", "площадь 5 м", 0.85, "structured_single"),
        ("1. площадь 5\n2. площадь 6", "площадь", "площадь 5; площадь 6", 0.8, "structured_multiple"),
        ("возможно, вероятно, примерно, около", "q", None, 0.7 - 0.1 - 0.1 - 0.1 - 0.1, "plain_text"),
    ],
)
def test_answer_formats(response, query, value, confidence, kind):
    got = answers.parse(response, query)
    assert (got["confidence"], got["format"]) == (confidence, kind)
    assert value is None or got["value"] == value


def test_native_parser_agrees_with_the_full_one(spark):
    rows = [(None,), ("",), ("нет данных",), ("Ответ: да",), ("просто текст " * 20,), ("возможно так",), (" пусто ",)]
    df = spark.createDataFrame(rows, "r string")
    got = df.select(answers.parse_native(F.col("r")).alias("n"), answers.parse_full(F.col("r"), F.lit("zz")).alias("f")).collect()
    assert all((x.n.value, x.n.confidence, x.n.format) == (x.f.value, x.f.confidence, x.f.format) for x in got)


def test_wrong_confidence_becomes_plain_text(spark):
    df = spark.createDataFrame([('{"value": 1, "confidence": null}',), ('{"value": 1, "confidence": "x"}',)], "r string")
    got = [x.f.format for x in df.select(answers.parse_full(F.col("r"), F.lit("zz")).alias("f")).collect()]
    assert got[0] == "plain_text" and got[1] != "json"


# Times and labels


def test_durations(spark):
    df = spark.createDataFrame([(None,), (0,), (59,), (60,), (61,), (3600,), (3660,), (7322,)], "s int")
    assert [r[0] for r in df.select(timefmt.duration(F.col("s"))).collect()] == [None, "0 сек.", "59 сек.", "1 мин.", "1 мин. 1 сек.", "1 ч.", "1 ч. 1 мин.", "2 ч. 2 мин."]
    assert df.where("s = 7322").select(timefmt.duration(F.col("s"), hours=False)).first()[0] == "122 мин. 2 сек."


def test_time_ago(spark):
    now = datetime.datetime(2024, 5, 20, 12)
    ago = [None, -5, 30, 120, 7200, 90000, 3 * 86400, 15 * 86400, 40 * 86400]
    df = spark.createDataFrame([(None if s is None else now - datetime.timedelta(seconds=s),) for s in ago], "t timestamp_ntz")
    got = [r[0] for r in df.select(timefmt.time_ago(F.col("t"), F.lit(now).cast("timestamp_ntz"))).collect()]
    assert got == ["", "только что", "только что", "2 мин. назад", "2 ч. назад", "вчера", "3 дн. назад", "2 нед. назад", "10.04.2024"]


def test_labels(spark):
    df = spark.createDataFrame([("analyzing", 1, 4), ("error", 0, 0), ("odd", 0, 0)], "s string, d int, t int")
    assert [r[0] for r in df.select(display.status_name(F.col("s"), F.col("d"), F.col("t"))).collect()] == ["Анализ (1/4)", "Ошибка", "odd"]
    got = spark.createDataFrame([("1, 2,x,,-3, 44",), ("",)], "s string").select(display.id_list(F.col("s"))).collect()
    assert [r[0] for r in got] == [[1, 2, 44], []]
    got = spark.createDataFrame([("a\nb",), (None,)], "s string").select(display.line_breaks(F.col("s"))).collect()
    assert [r[0] for r in got] == ["a<br>b", ""]


# Reports


def test_page_ranges(spark):
    lists = [["2", "3", "4", "6"], ["10,11", "2"], ["x", "7"], ["x", "y"], [], ["5", "5"]]
    df = spark.createDataFrame([(x,) for x in lists], "p array<string>")
    assert [r[0] for r in df.select(report.page_list(F.col("p"))).collect()] == ["2-4, 6", "2, 10-11", "7", "x, y", "", "5"]
    rows = spark.createDataFrame([(1, p) for p in (6, 2, 4, 3, 3)] + [(2, None), (2, 9)], "k int, page_number int")
    assert values(report.page_ranges(rows, ["k"]), "k", "ranges") == [(1, "2-4, 6"), (2, "9")]


def test_context_names_what_is_known(spark):
    schema = "k int, position int, document_name string, document_id bigint, page_number int, chunk_index int, text string"
    hits = spark.createDataFrame([(1, 2, None, 7, 0, 0, None), (1, 1, "a.pdf", 7, 3, None, "t")], schema)
    got = context.contexts(hits, ["k"]).first().context
    line = "=" * 30
    assert got == f"===== Результат 1 =====\n[Источник: Документ: a.pdf, Страница: 3]\n\nt\n{line}\n\n===== Результат 2 =====\n[Источник: Документ ID: 7, Чанк: 0]\n\n\n{line}\n"
    assert context.contexts(hits, ["k"], most=1).first().context.count("Результат") == 1


def test_prompt_template(spark):
    df = spark.createDataFrame([("q", "c")], "q string, c string")
    assert df.select(context.prompt('{{"a"}} {query}: {context}', F.col("q"), F.col("c"))).first()[0] == '{"a"} q: c'
    with pytest.raises(KeyError):
        context.prompt("{other}", F.col("q"), F.col("c"))


# Batches of chunks


def greedy(lengths, most):
    out, batch, filled, is_open = [], -1, 0, False
    for n in lengths:
        if n == 0:
            continue
        if n is None or n < 0:
            batch, is_open = batch + 1, False
        elif is_open and filled + n <= most:
            filled += n
        else:
            batch, filled, is_open = batch + 1, n, True
        out.append(batch)
    return out


def test_batches_keep_order_and_size(spark):
    r = random.Random(4)
    cases = {a: [r.choice([0, None, -1, 5, 40, 99, 100, 101, 250]) for _ in range(n)] for a, n in ((1, 200), (2, 1), (3, 0), (4, 37))}
    rows = [(a, 1, i, n) for a, ns in cases.items() for i, n in enumerate(ns)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "application_id int, document_id bigint, chunk_index int, content_length int")
    got = chunks.pack_batches(df, 100).orderBy("application_id", "chunk_index").collect()
    for a, ns in cases.items():
        assert [x.batch_index for x in got if x.application_id == a] == greedy(ns, 100)


def test_first_match_counts_scanned_chunks(spark):
    rows = [(1, 0, 3, False), (1, 1, 4, True), (1, 2, 5, True), (2, 0, 2, False), (2, 1, 2, False)]
    df = spark.createDataFrame(rows, "application_id int, batch_index int, n_chunks int, hit boolean")
    assert values(chunks.first_match(df, F.col("hit")), "application_id", "first_batch", "chunks_scanned") == [(1, 1, 7), (2, None, 4)]


def test_documents_are_cut_whole(spark):
    texts = ["", None, "a" * 800, "b" * 801, "é日" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for x in chunks.split_documents(df).orderBy("document_id", "chunk_index").collect():
        assert len(x.text) <= 800
        got[x.document_id] = got.get(x.document_id, "") + x.text
    assert got == {i: t for i, t in enumerate(texts) if t}


# Retrieval


def test_search_ranks_by_case_and_in_request_order(spark):
    rows = [(a, d, 0, "the word" if d % 2 else "none", s) for a, d, s in ((1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9), (2, 4, 0.1), (3, 5, 1.0))]
    df = spark.createDataFrame(rows, "application_id int, document_id bigint, chunk_index int, text string, score double")
    assert values(retrieval.top_k(df, 2), "application_id", "position", "document_id") == [(1, 1, 2), (1, 2, 3), (2, 1, 4), (3, 1, 5)]
    got = retrieval.across_cases(df, [2, 1], 2).orderBy("global_position").collect()
    assert [(x.application_id, x.position, x.document_id) for x in got] == [(2, 1, 4), (1, 1, 2), (1, 2, 3)]
    assert values(retrieval.rerank(df.where("application_id = 1"), ["the"], 2, 1), "document_id") == [(3,)]
    limits = spark.createDataFrame([(None,), (5,)], "total_points int")
    assert [retrieval.rerank_limit(x).first()[0] for x in (limits, limits.where("total_points = 0"))] == [105, 1000]


# Access, states and mutations


def test_access_and_gate(spark):
    apps = spark.createDataFrame([(1, 7, "error"), (2, None, "indexed"), (3, 8, "created")], "id bigint, user_id bigint, status string")
    assert values(access.accessible_cases(apps, "user", 7), "id") == [(1,)]
    assert access.accessible_cases(apps, "admin", 7).count() == 3
    asked = spark.createDataFrame([(1,), (3,), (99,)], "id bigint")
    assert values(access.rejected_cases(asked, apps, "user", 7), "id") == [(3,), (99,)]
    files = spark.createDataFrame([(1, 1, "completed"), (2, 3, "completed")], "id bigint, application_id bigint, indexing_status string")
    links = spark.createDataFrame([(1, 5), (2, 5)], "application_id bigint, checklist_id bigint")
    assert values(status.ready_to_analyze(apps, files, links), "id", "ready") == [(1, True), (2, True), (3, False)]
    with pytest.raises(LookupError):
        access.role_of(spark.createDataFrame([(1, "user")], "id bigint, role string"), 2)


def test_status_reducers_differ_where_errors_meet_success(spark):
    apps = spark.createDataFrame([(i, "analyzing") for i in range(5)], "id bigint, last_operation string")
    states = {1: ["completed", "error"], 2: ["error", "indexing"], 3: ["completed", "completed"], 4: ["pending"]}
    files = spark.createDataFrame([(a, s) for a, ss in states.items() for s in ss], "application_id bigint, indexing_status string")
    assert values(status.reduce_worker(apps, files), "id", "status") == [(0, "created"), (1, "error"), (2, "indexing"), (3, "indexed"), (4, "created")]
    assert values(status.reduce_web(apps, files), "id", "status") == [(0, "created"), (1, "indexed"), (2, "error"), (3, "indexed"), (4, "created")]


def test_ordering_mutations(spark):
    p = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 0)], "id bigint, checklist_id bigint, order_index int")
    order = lambda df: {r.id: r.order_index for r in df.collect()}
    assert order(mutations.delete_parameters(p, [1])) == {2: 0, 3: 1, 4: 0}
    assert order(mutations.swap_with_neighbour(p, [2], up=True)) == {1: 1, 2: 0, 3: 2, 4: 0}
    assert order(mutations.swap_with_neighbour(p, [3], up=False)) == {1: 0, 2: 1, 3: 2, 4: 0}
    assert order(mutations.reorder(p, 1, [3, 4, 1])) == {3: 0, 2: 1, 1: 2, 4: 0}


def test_upsert_keeps_identity_and_settles_ties(spark):
    now = spark.createDataFrame([(10, 1, "a", "old", "t1"), (11, 2, "b", "old", "t2")], "id bigint, k int, v string, w string, created_at string")
    new = spark.createDataFrame([(2, "c", 1, 99), (2, "d", 2, 98), (2, "e", 2, 97), (3, None, 5, 50)], "k int, v string, seq int, id bigint")
    got = mutations.merge_by_key(now, new, ["k"], order=("seq",))
    assert values(got, "id", "k", "v", "w", "created_at") == sorted([(10, 1, "a", "old", "t1"), (11, 2, "d", "old", "t2"), (50, 3, None, None, None)], key=str)
    repeats = spark.createDataFrame([(9, 1, 1, "late"), (4, 1, 1, "first"), (5, 1, 2, "x")], "id bigint, application_id bigint, parameter_id bigint, value string")
    assert values(report.first_results(repeats), "id", "value") == [(4, "first"), (5, "x")]


def test_upserts_never_multiply_links_by_parameters(spark):
    results = spark.createDataFrame([(1, 1, 7, "a"), (2, 1, 8, "b"), (3, 2, 7, "c")], "id bigint, application_id bigint, parameter_id bigint, value string")
    parameters = spark.createDataFrame([(7, 70), (8, 80)], "id bigint, checklist_id bigint")
    links = spark.createDataFrame([(1, 70), (2, 80)], "application_id bigint, checklist_id bigint")
    assert values(mutations.upsert_results(results, results.withColumn("value", F.lit("n")), parameters, links), "id", "value") == [(1, "n"), (2, "b"), (3, "c")]
    cases = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert values(mutations.delete_stale_results(results, cases, parameters, links), "id") == [(2,), (3,)]


def test_users_and_seed(spark):
    users = spark.createDataFrame([(1, "a", "a@x", "admin"), (2, "b", "b@x", "user")], "id bigint, username string, email string, role string")
    assert values(mutations.deletion_errors(users, 2), "id", "error") == [(1, "last admin"), (2, "self")]
    wanted = spark.createDataFrame([("new", "b@x", "secret1", "user"), ("a", "n@x", "short", "boss"), (None, " ", None, None)], "username string, email string, password string, role string")
    assert values(mutations.user_errors(wanted, users), "errors") == sorted([(["email taken"],), (["username taken", "password too short", "unknown role"],), (["required", "password too short", "unknown role"],)], key=str)
    assert {k: df.count() for k, df in mutations.seed(spark, users.limit(0)).items()} == {"users": 1, "checklists": 1, "parameters": 3}
    assert {k: df.count() for k, df in mutations.seed(spark, users).items()} == {"users": 0, "checklists": 0, "parameters": 0}


def test_uploads_are_scanned_by_kind_and_size(spark, tmp_path, monkeypatch):
    from casewright.sources import uploads

    (tmp_path / "in").mkdir()
    for name, size in (("a scan v1.pdf", 10), ("b.pdf", 2000), ("c.txt", 5)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    monkeypatch.setattr(uploads, "MAX_BYTES", 1000)
    (row,) = uploads.scan_uploads(spark, str(tmp_path), content=True).collect()
    assert (row.size, bytes(row.content), row.file_type) == (10, b"x" * 10, "document")
    assert row.stored_name.endswith(".pdf") and "/" not in row.stored_name and " " not in row.stored_name


def test_clone_names(spark):
    names = spark.createDataFrame([(1, "X"), (2, "X (копия)"), (3, "X (копия 3)"), (4, "Y")], "id bigint, name string")
    got = dict(values(mutations.clone_names(names), "id", "clone_name"))
    assert got == {1: "X (копия 2)", 2: "X (копия) (копия)", 3: "X (копия 3) (копия)", 4: "Y (копия)"}


# Streams


def test_stream_equals_batch(spark, tmp_path):
    """Two runs over what has come, with the states in between, give the changes of one batch; a missing progress counts as 100."""
    start, r = datetime.datetime(2024, 1, 1), random.Random(2)
    rows = [(i, f"t{i % 3}", start + datetime.timedelta(minutes=i), "PROGRESS", r.choice([-5, 10, 10, 50, 120, None])) for i in range(80)]
    schema = "event_id bigint, task_id string, ts timestamp_ntz, state string, progress int"
    for part in (rows[:40], rows[40:], []):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = progress.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        progress.write_progress_changes(stream, str(tmp_path / "out"), str(tmp_path / "states"), str(tmp_path / "checkpoint"))
    got = values(spark.read.parquet(str(tmp_path / "out")), "task_id", "event_id", "progress")
    last, want = {}, []
    for i, t, _, _, p in rows:
        p = 100 if p is None else max(0, min(100, p))
        if last.get(t) != p:
            want.append((t, i, p))
        last[t] = p
    assert got == sorted(want, key=str)
    assert values(progress.progress_changes(spark.createDataFrame(rows, schema)), "task_id", "event_id", "progress") == got
