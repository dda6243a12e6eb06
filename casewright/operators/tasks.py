"""Tasks: calls of a model that may fail, what tasks tell about themselves, and analyses that can be stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.extraction import ask
from casewright.sources import partitions

#: Requests that one task has on their way at once, and how often a failed one is sent again.
CONCURRENCY, RETRIES = 4, 2
CALLED = "request bigint, model string, response string, tokens bigint, reason string, tries int"


def call_model(requests: DataFrame, send: Callable[[str, str, int], tuple[str, int]], concurrency: int = CONCURRENCY, retries: int = RETRIES) -> DataFrame:
    """CALLED: one row for each request (request, model, prompt), with the response and its tokens, or the reason why there is none.

    `send(model, prompt, attempt)` gives the response and how many tokens it took, or raises; attempts count from 1. A
    task has at most `concurrency` requests under way and holds one Arrow batch; results keep the batch's order. A
    request that fails is a row like any other, so one of them doesn't end the job. A task that is run again sends its
    requests again.
    """

    def provider(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        def one(row):
            request, model, prompt = row
            for attempt in range(1, retries + 2):
                try:
                    response, tokens = send(model, prompt, attempt)
                    return request, model, response, tokens, None, attempt
                except Exception as e:  # whatever a service throws is the row's reason
                    reason = f"{type(e).__name__}: {e}"
            return request, model, None, None, reason, retries + 1

        names = ["request", "model", "response", "tokens", "reason", "tries"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32()]
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                rows = list(pool.map(one, zip(*(batch.column(c).to_pylist() for c in ("request", "model", "prompt")))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return ask(requests.select("request", "model", "prompt"), provider, CALLED)


def last_wins(left: Column, right: Column) -> Column:
    """Both maps' keys; where both have one, the right one's value. A null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def merged_meta(events: DataFrame) -> DataFrame:
    """task_id, meta: of each key that a task's events (task_id, seq, meta) tell the last value; of one seq the greater one. Keys stand in order."""
    told = events.select("task_id", "seq", F.explode("meta"))
    last = told.groupBy("task_id", "key").agg(F.max(F.struct("seq", "value")).alias("m"))
    pairs = last.groupBy("task_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "m.value")))).alias("meta"))
    every = events.select("task_id").distinct()
    return every.join(pairs, "task_id", "left").select("task_id", F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"))


#: What a task that ended well tells, unless its result says otherwise.
ENDED = {"progress": "100", "stage": "complete", "message": "Задача успешно завершена"}


def ended_meta(result: Column) -> Column:
    """The meta of a task that ended well: its result over what every such task tells."""
    return last_wins(F.create_map(*(F.lit(x) for pair in ENDED.items() for x in pair)), result)


def run_in_parts(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, keys: list[str], parts: int = 16, tag: str = "analysis") -> DataFrame:
    """work(jobs), made and written in `parts` by the jobs' keys, one after another, under a tag that stops it.

    stop(spark, tag), from any thread, ends the part that is being made, and with it this call. Parts that were done stay
    whole; called again, it makes only the others. A part is done once its job has committed. (The tag is the context's,
    as a session's tags are seen only by the thread that set them.)
    """
    spark: SparkSession = jobs.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    spark.sparkContext.addJobTag(tag)
    try:
        for k in range(parts):
            if not partitions.exists(spark, f"{path}/part={k}/_SUCCESS"):
                work(jobs.where(part == k)).write.mode("overwrite").parquet(f"{path}/part={k}")
    finally:
        spark.sparkContext.removeJobTag(tag)
    return spark.read.schema(work(jobs.limit(0)).schema).parquet(*(f"{path}/part={k}" for k in range(parts)))


def stop(spark: SparkSession, tag: str = "analysis") -> None:
    """Cancels the jobs under a tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
