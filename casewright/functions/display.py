"""Labels of states, and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is shown of each state.
STATUS_NAMES = {"created": "Создана", "indexing": "Индексация", "indexed": "Проиндексирована", "analyzed": "Проанализирована", "error": "Ошибка"}


def status_name(status: Column, done: Column, total: Column) -> Column:
    """The state's name; an analysis shows its progress, an unknown state itself."""
    out = F.when(status == "analyzing", F.concat(F.lit("Анализ ("), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(")")))
    for state, name in STATUS_NAMES.items():
        out = out.when(status == state, name)
    return out.otherwise(status)


def line_breaks(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit(""))


def id_list(text: Column) -> Column:
    """Whole numbers of a comma-separated list."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("bigint"))


def secure_filename(name: Column) -> Column:
    """A name without folders: runs of blanks and slashes become one underscore, other odd characters go, and dots and underscores at the start."""
    joined = F.regexp_replace(name, r"[ /\\]+", "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^\p{L}\p{N}_.-]", ""), r"^[._]+", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """With its dot; empty without one."""
    return F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)
