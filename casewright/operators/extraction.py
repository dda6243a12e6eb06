"""The extraction pipeline: search, answer, parse, full scan of what wasn't found."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import answers
from casewright.sources.storage import materialize

MISS = "информация не найдена"
#: Parts over which the batches of one case are dealt for full scans.
SALTS = 64


def ask(requests: DataFrame, provider: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Sends prompts to a model in Arrow batches; rows of one model lie together, so that a task loads few.

    `provider` maps batches of `requests` to batches of `schema`. Repartitioning by model and a salt keeps the
    commonest model from landing in one task.
    """
    salt = F.pmod(F.xxhash64(*requests.columns), F.lit(64))
    return requests.repartition("model", salt).sortWithinPartitions("model").mapInArrow(provider, schema)


def stub_answer(text: Column, word: Column) -> Column:
    """A deterministic stand-in for a model: the 40 characters from the word's first place, or the literal that nothing was found."""
    at = F.position(word, F.lower(text))
    return F.when(at > 0, F.substring(text, at, F.lit(40))).otherwise(answers.NOT_FOUND)


def was_found(value: Column) -> Column:
    return ~F.contains(F.lower(value), F.lit(MISS))


def run_checklists(parameters: DataFrame, hits: DataFrame, batches: DataFrame, by: Sequence[str] = ("application_id",)) -> DataFrame:
    """application_id, parameter_id, value, confidence, chunks_scanned: search answers, then full scans where asked for.

    parameters: application_id, parameter_id, word, use_full_scan and the columns of `by`. hits: `by`, position, text
    (each search's own top k). batches: application_id, batch_index, n_chunks, text. Parameters that ask the same are
    asked once; one without hits gets the answer that nothing was found. A case's open words meet its batches once
    each, dealt over SALTS parts; answers are taken as they are found, so no prompt is built for what a first stage
    answered.
    """
    ask = [*dict.fromkeys(["application_id", *by]), "word", "use_full_scan"]
    asks = parameters.select(*ask).distinct()
    first = asks.join(hits.select(*by, "position", "text"), list(by), "left").withColumn("answer", stub_answer(F.col("text"), F.col("word")))
    place = F.coalesce("position", F.lit(0))
    best = first.groupBy(*ask).agg(F.min_by("answer", F.when(was_found(F.col("answer")), place).otherwise(place + 1_000_000)).alias("answer"))
    parsed = materialize(best.withColumn("confidence", F.when(was_found(F.col("answer")), answers.confidence(F.col("answer"))).otherwise(0.1)), "answers")
    told = parsed.select(*(F.col(c).alias(f"a_{c}") for c in ask), "answer", "confidence")
    same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in ask]
    answered = parameters.join(told, reduce(and_, same)).select("application_id", "parameter_id", "word", "use_full_scan", "answer", "confidence")
    open_ = ~was_found(F.col("answer")) & F.coalesce("use_full_scan", F.lit(False))
    done = answered.where(~open_).select("application_id", "parameter_id", F.col("answer").alias("value"), "confidence", F.lit(None).cast("bigint").alias("chunks_scanned"))

    words = parsed.where(open_).select("application_id", "word").distinct()
    scans = full_scans(words, batches).select(F.col("application_id").alias("s_case"), F.col("word").alias("s_word"), "value", "scanned", "first")
    rest = answered.where(open_).join(scans, (F.col("application_id") == F.col("s_case")) & F.col("word").eqNullSafe(F.col("s_word")))
    # A parameter with several words is scanned for each, up to the first batch that answers any.
    rest = rest.groupBy("application_id", "parameter_id").agg(F.min("first").alias("first"), F.min_by("value", "first").alias("value"), F.min_by("scanned", "first").alias("upto"), F.sum("scanned").alias("n_all"))
    found = F.col("first").isNotNull()
    missed = F.concat(F.lit("Информация не найдена по всем "), F.col("n_all").cast("string"), F.lit(" чанкам"))
    scanned = rest.select("application_id", "parameter_id", F.when(found, F.col("value")).otherwise(missed).alias("value"), F.when(found, 0.9).otherwise(0.1).alias("confidence"), F.when(found, F.col("upto")).otherwise(F.col("n_all")).alias("chunks_scanned"))
    return done.unionByName(scanned)


def full_scans(words: DataFrame, batches: DataFrame) -> DataFrame:
    """application_id, word, first, value, scanned: the first batch of the case that answers, or null, and the chunks read till then."""
    keys, part = ["application_id", "word"], F.pmod("batch_index", F.lit(SALTS)).alias("salt")
    dealt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    words, batches = materialize(words, "words"), materialize(batches, "batches")
    scan = words.select(*keys, dealt).join(batches.select("application_id", "batch_index", "text", part), ["application_id", "salt"])
    hit = scan.withColumn("answer", stub_answer(F.col("text"), F.col("word"))).where(was_found(F.col("answer")))
    firsts = hit.groupBy(*keys).agg(F.min("batch_index").alias("first"), F.min_by("answer", "batch_index").alias("value"))
    marked = materialize(words.alias("w").join(firsts.alias("f"), (F.col("w.application_id") == F.col("f.application_id")) & (F.col("w.word") == F.col("f.word")), "left").select("w.*", "first", "value"), "scans")
    sizes = batches.select("application_id", "batch_index", "n_chunks", part)
    upto = marked.select("application_id", "first").distinct()
    read = upto.select("*", dealt).join(sizes, ["application_id", "salt"], "left").where(F.col("first").isNull() | (F.col("batch_index") <= F.col("first")))
    read = read.groupBy("application_id", "first").agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("scanned")).select(F.col("application_id").alias("r_case"), F.col("first").alias("r_first"), "scanned")
    return marked.join(read, (F.col("application_id") == F.col("r_case")) & F.col("first").eqNullSafe(F.col("r_first"))).select(*keys, "first", "value", "scanned")
