"""Catalogue tables whose columns grow: what a table has, and columns that older files do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def columns_of(spark: SparkSession, table: str) -> dict[str, str]:
    """name -> type, as the catalogue has them."""
    return {c.name: c.dataType for c in spark.catalog.listColumns(table)}


def create_table(df: DataFrame, table: str, path: str) -> None:
    """A table of the rows as Parquet files under `path`; one that is there already stays as it is."""
    if not df.sparkSession.catalog.tableExists(table):
        df.write.option("path", path).saveAsTable(table, format="parquet")


def add_missing_columns(spark: SparkSession, table: str, columns: dict[str, tuple[str, str | None]]) -> list[str]:
    """Adds the columns (name -> type, default as SQL or None) that the table lacks, in any case of letters; gives their names.

    No file is rewritten: rows of older files read the default, or null. Run again, it changes nothing.
    """
    known = {name.lower() for name in columns_of(spark, table)}
    missing = {name: column for name, column in columns.items() if name.lower() not in known}
    if missing:
        told = ", ".join(f"`{name}` {kind}" + (f" DEFAULT {default}" if default is not None else "") for name, (kind, default) in missing.items())
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({told})")
    return list(missing)
