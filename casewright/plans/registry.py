"""Registry of the engine's queries and of the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable

from casewright.sources.relations import with_clause

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(*uses: str, sql: str | None = None, recursive: bool = False):
    """Registers a (spark, sf_dir) -> DataFrame function; sql states it over the relations in `uses`."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            head = with_clause(*uses, recursive=recursive)
            ORACLES[function.__name__] = head + (("," if head and sql.lstrip()[:1] == "+" else "") + sql.lstrip().removeprefix("+"))
        return function

    return add


from casewright.plans import case_queries, chunk_queries, edit_queries, stream_queries, task_queries, text_queries  # noqa: E402, F401  (they register themselves)
