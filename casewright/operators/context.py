"""Context blocks and prompts for the language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A search's answer reads so many hits.
MOST_IN_CONTEXT = 8


def source_line(name: Column, document_id: Column, page: Column, chunk: Column) -> Column:
    """[Источник: ...] of what is known; an empty name or page 0 counts as unknown, chunk 0 doesn't."""
    doc = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("Документ: "), name)).when(document_id.isNotNull(), F.concat(F.lit("Документ ID: "), document_id.cast("string"))).otherwise("")
    at = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", Страница: "), page.cast("string"))).otherwise("")
    part = F.when(chunk.isNotNull(), F.concat(F.lit(", Чанк: "), chunk.cast("string"))).otherwise("")
    return F.concat(F.lit("[Источник: "), doc, at, part, F.lit("]"))


def single_chunk(name: Column, document_id: Column, page: Column, pages: Column, chunk: Column, chunk_id: Column, text: Column) -> Column:
    """One chunk as a context of its own: a list of pages stands in for a missing page, an identifier for a missing number."""
    doc = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("Документ: "), name)).when(document_id.isNotNull(), F.concat(F.lit("Документ ID: "), document_id.cast("string"))).otherwise("")
    at = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(", Страница: "), page.cast("string"))).when(F.size(pages) > 0, F.concat(F.lit(", Страницы: "), F.array_join(pages.cast("array<string>"), ", "))).otherwise("")
    part = F.when(chunk.isNotNull(), F.concat(F.lit(", Чанк: "), chunk.cast("string"))).when(F.coalesce(chunk_id, F.lit("")) != "", F.concat(F.lit(", Чанк: "), chunk_id)).otherwise("")
    return F.concat(F.lit("[Источник: "), doc, at, part, F.lit("]\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def block(position: Column, source: Column, text: Column) -> Column:
    return F.concat(F.lit("===== Результат "), position.cast("string"), F.lit(" =====\n"), source, F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n" + "=" * 30 + "\n"))


def contexts(hits: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """context of each key's hits in order of position, a bounded top-k; `most` keeps the first so many."""
    chosen = hits if most is None else hits.where(F.col("position") <= most)
    source = source_line(F.col("document_name"), F.col("document_id"), F.col("page_number"), F.col("chunk_index"))
    rows = chosen.select(*keys, F.struct("position", block(F.col("position"), source, F.col("text")).alias("b")).alias("x"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]), "\n").alias("context"))


def prompt(template: str, query: Column, context: Column) -> Column:
    """The template with {query} and {context} filled in, doubled braces single; another placeholder fails, as there is nothing to fill it."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            parts.append({"query": query, "context": context}[name])
    return F.concat(*parts)
