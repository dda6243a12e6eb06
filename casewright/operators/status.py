"""Status reducers, gates and the task state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.timefmt import duration

FILE_STATES = ("pending", "indexing", "completed", "error")
READY = ("indexed", "analyzed")


def file_status_counts(files: DataFrame) -> DataFrame:
    """Files of each case by state, in one pass with partial aggregation."""
    return files.groupBy("application_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("indexing_status") == s).alias(s) for s in FILE_STATES))


def _with_counts(applications: DataFrame, files: DataFrame) -> DataFrame:
    counts = file_status_counts(files).withColumnRenamed("application_id", "of_application")
    return applications.join(counts, F.col("id") == F.col("of_application"), "left").na.fill(0, ["total", *FILE_STATES])


def _text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def reduce_worker(applications: DataFrame, files: DataFrame) -> DataFrame:
    """status, status_message and last_operation of each case as the indexing worker derives them: indexing before errors before success."""
    total, indexing, completed, error = (F.col(c) for c in ("total", "indexing", "completed", "error"))
    failed = (total > 0) & (indexing == 0) & (error > 0)
    done = (total > 0) & (completed == total)
    status = F.when(total == 0, "created").when(indexing > 0, "indexing").when(error > 0, "error").when(done, "indexed").otherwise("created")
    message = F.when(failed & (completed > 0), _text("Индексация завершена с ошибками. Успешно: ", completed, ", Ошибок: ", error))
    message = message.when(failed, _text("Ошибка индексации всех файлов (", error, ")")).when(done, _text("Успешно проиндексировано файлов: ", total))
    return _with_counts(applications, files).select("id", status.alias("status"), message.alias("status_message"), F.when(failed, "indexing").otherwise(F.col("last_operation")).alias("last_operation"))


def reduce_web(applications: DataFrame, files: DataFrame) -> DataFrame:
    """The web's order: success before errors before indexing; a case with some successes counts as indexed."""
    total, indexing, completed, error = (F.col(c) for c in ("total", "indexing", "completed", "error"))
    done = (total > 0) & (completed == total)
    status = F.when(total == 0, "created").when(done, "indexed").when((error > 0) & (completed > 0), "indexed").when(error > 0, "error").when(indexing > 0, "indexing").otherwise("created")
    message = F.when(done, _text("Проиндексировано файлов: ", total)).when(error > 0, _text("Успешно: ", completed, ", Ошибок: ", error))
    return _with_counts(applications, files).select("id", status.alias("status"), message.alias("status_message"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise((done / total * 100).cast("int"))


def ready_to_analyze(applications: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """id, ready: a case in error needs a completed file, others a ready status; all need a checklist."""
    completed = files.where(F.col("indexing_status") == "completed").select(F.col("application_id").alias("f")).distinct()
    listed = links.select(F.col("application_id").alias("l")).distinct()
    joined = applications.join(completed, F.col("id") == F.col("f"), "left").join(listed, F.col("id") == F.col("l"), "left")
    gate = F.when(F.col("status") == "error", F.col("f").isNotNull()).otherwise(F.col("status").isin(*READY))
    return joined.select("id", (gate & F.col("l").isNotNull()).alias("ready"))


def stop_analysis(applications: DataFrame) -> DataFrame:
    """id, status, status_message, last_operation after the user stops an analysis: partial results count as analysed."""
    done, total = F.col("analysis_completed_params"), F.col("analysis_total_params")
    message = F.when(done > 0, _text("Анализ остановлен пользователем. Обработано параметров: ", done, " из ", total)).otherwise("Анализ остановлен пользователем")
    return applications.select("id", F.when(done > 0, "analyzed").otherwise("indexed").alias("status"), message.alias("status_message"), F.lit("analyzing").alias("last_operation"))


def stopped_at(applications: DataFrame, now: Column) -> DataFrame:
    """stop_analysis with analysis_completed_at: the time of stopping, unless the analysis had ended before."""
    ended = applications.select(F.col("id").alias("e_id"), F.coalesce("analysis_completed_at", now).alias("analysis_completed_at"))
    return stop_analysis(applications).join(ended, F.col("id") == F.col("e_id")).drop("e_id")


def indexing_seconds(files: DataFrame, now: Column) -> DataFrame:
    """application_id, ended, going: seconds of indexing of each case's files with both ends, and of all that have begun, those without an end up to `now`."""
    seconds = lambda end: F.timestamp_diff("SECOND", F.col("indexing_started_at"), end)
    end = F.col("indexing_completed_at")
    return files.groupBy("application_id").agg(F.coalesce(F.sum(seconds(end)), F.lit(0)).alias("ended"), F.coalesce(F.sum(seconds(F.coalesce(end, now))), F.lit(0)).alias("going"))


def status_messages(applications: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """id, message: the status message with how long its operation took; nothing is added where that is unknown or no time at all.

    applications: id, status, last_operation, status_message, analysis_started_at, analysis_completed_at.
    """
    took = indexing_seconds(files, now).withColumnRenamed("application_id", "f_id")
    joined = applications.join(took, F.col("id") == F.col("f_id"), "left")
    state, begun, end = F.col("status"), F.col("analysis_started_at"), F.col("analysis_completed_at")
    analysis = lambda e: F.timestamp_diff("SECOND", begun, e)
    indexed = F.when(F.col("ended") > 0, _text(" (", duration(F.col("ended")), ")"))
    analyzed = _text(" (", duration(analysis(end)), ")")
    failed = F.when(F.col("last_operation") == "indexing", F.when(F.col("going") > 0, _text(" (выполнялось ", duration(F.col("going")), ")"))).when(F.col("last_operation") == "analyzing", _text(" (выполнялось ", duration(analysis(F.coalesce(end, now))), ")"))
    suffix = F.when(state == "indexed", indexed).when(state == "analyzed", analyzed).when(state == "error", failed)
    told = F.coalesce("status_message", F.lit("")) != ""
    return joined.select("id", F.when(told, F.concat("status_message", F.coalesce(suffix, F.lit("")))).alias("message"))


def first_file_error(files: DataFrame) -> DataFrame:
    """The message of each case's first failed file that has one."""
    failed = files.where((F.col("indexing_status") == "error") & (F.coalesce("error_message", F.lit("")) != ""))
    return failed.groupBy("application_id").agg(F.min_by("error_message", "id").alias("error_message"))


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each task, by time and id."""
    return events.groupBy("task_id").agg(F.max_by(F.struct("event_id", "state", "progress"), F.struct("ts", "event_id")).alias("e")).select("task_id", "e.*")


def clamp(progress: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), progress))


def search_response(state: Column) -> Column:
    """What a search's poll answers for a task state."""
    return F.when(state == "PENDING", "pending").when(state == "PROGRESS", "progress").when(state == "SUCCESS", "success").when(state == "FAILURE", "error").otherwise("unknown")


def terminal(status: Column, state: Column, progress: Column, message: Column) -> Column:
    """The client's verdict on a poll: error (also told by the message) before success, else running."""
    told = F.coalesce(F.lower(message).contains("ошибка"), F.lit(False))
    wrong = status.isin("error", "cancelled") | (state == "FAILURE") | told
    right = (status == "success") | (state == "SUCCESS") | (progress >= 100) | status.isin(*READY)
    return F.when(F.coalesce(wrong, F.lit(False)), "error").when(F.coalesce(right, F.lit(False)), "success").otherwise("running")


def resource_band(load: Column) -> Column:
    return F.when(load < 40, "low").when(load < 70, "medium").when(load < 90, "high").otherwise("critical")


def application_responses(applications: DataFrame, latest: DataFrame, files: DataFrame) -> DataFrame:
    """id, response, progress, message of a poll for each case and its task (task_id, state, progress of the last event).

    A failed file ends indexing; an analysis shows its worker's progress or, where that is 0 or missing, the stored
    parameters'; a stored error ends the rest, then the task's state counts, and without a task the case's own.
    """
    failed = files.where("indexing_status = 'error'").groupBy(F.col("application_id").alias("f_id")).agg(F.min_by("error_message", F.when(F.coalesce("error_message", F.lit("")) != "", F.col("id"))).alias("told"))
    task = latest.select(F.col("task_id").alias("t_id"), "state", F.col("progress").alias("worker"))
    joined = applications.join(task, F.col("task_id") == F.col("t_id"), "left").join(failed, F.col("id") == F.col("f_id"), "left")
    wrong = (F.col("status") == "indexing") & F.col("f_id").isNotNull()
    state, stored = F.col("state"), F.when(F.col("status").isin(*READY), 100).otherwise(0)
    done = percent(F.col("analysis_completed_params"), F.col("analysis_total_params"))
    running = F.when((state == "PROGRESS") & (F.col("worker") != 0), F.col("worker")).otherwise(done)
    by_state = F.when(state == "PENDING", "pending").when(state == "PROGRESS", "progress").when(state == "SUCCESS", "success").when(state == "FAILURE", "error").when(state.isNotNull(), F.lower(state)).otherwise(F.col("status"))
    response = F.when(wrong, "error").when(F.col("status") == "analyzing", "progress").when(F.col("status") == "error", "error").otherwise(by_state)
    of_state = F.when(state == "PENDING", 0).when(state == "PROGRESS", F.col("worker")).when(state == "SUCCESS", 100).when(state.isNotNull(), F.lit(None)).otherwise(stored)
    progress = F.when(wrong, 0).when(F.col("status") == "analyzing", running).when(F.col("status") == "error", 0).otherwise(of_state)
    return joined.select("id", response.alias("response"), progress.cast("int").alias("progress"), F.when(wrong, F.coalesce("told", F.lit("Ошибка при индексации файла"))).alias("message"))


def deadlines(events: DataFrame, now, poll_seconds: int = 7200, result_seconds: int = 3600) -> DataFrame:
    """task_id, timed_out (still running, polled for longer than that), expired (ended, its result kept longer than that) at `now`."""
    per = events.groupBy("task_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.min("ts").alias("began"), F.max("ts").alias("last"))
    running = F.col("state").isin("PENDING", "PROGRESS")
    older = lambda c, s: F.timestamp_diff("MICROSECOND", F.col(c), F.lit(now).cast("timestamp_ntz")) > s * 1_000_000
    return per.select("task_id", (running & older("began", poll_seconds)).alias("timed_out"), (~running & older("last", result_seconds)).alias("expired"))


#: Where each stage of an analysis begins, and its share of the whole.
STAGES = {"search": (5, 40), "ask": (50, 35), "scan": (85, 10)}


def stage_progress(stage: str, done: Column, total: Column) -> Column:
    start, share = STAGES[stage]
    return start + (done / total * share).cast("int")
