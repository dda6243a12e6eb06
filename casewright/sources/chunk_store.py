"""Indexed chunks as files by case, so that indexing or deleting a file rewrites only its case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources import partitions

CASE = "application_id"


class ChunkStore:
    """Chunks (application_id, document_id, file_id, chunk_index, ...) under `path`. Chunks of older indexes have no file_id."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        """All chunks; a filter or join on the case reads only its folder."""
        if not partitions.exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def _of(self, cases: DataFrame) -> DataFrame:
        return self.read().join(cases.select(CASE).distinct(), CASE, "left_semi")

    def index(self, chunks: DataFrame) -> None:
        """Adds chunks; those that a document of theirs had before go."""
        new = chunks.select(*self.schema.names)
        documents = new.select(CASE, "document_id").distinct()
        kept = self._of(new).join(documents, [CASE, "document_id"], "left_anti")
        partitions.rewrite(kept.select(*self.schema.names).unionByName(new), new.select(CASE), self.path, CASE)

    def delete_documents(self, documents: DataFrame) -> None:
        """Removes the chunks of (application_id, document_id)."""
        kept = self._of(documents).join(documents, [CASE, "document_id"], "left_anti")
        partitions.rewrite(kept.select(*self.schema.names), documents.select(CASE), self.path, CASE)

    def delete_files(self, files: DataFrame) -> None:
        """Removes the chunks of (application_id, file_id, document_id): those of the file, or the document's where no chunk of the case names the file."""
        held = self._of(files)
        known = held.where(F.col("file_id").isNotNull()).select(CASE, "file_id").distinct()
        by_file = files.join(known, [CASE, "file_id"], "left_semi").select(CASE, "file_id").distinct()
        by_document = files.join(known, [CASE, "file_id"], "left_anti").select(CASE, "document_id").distinct()
        kept = held.join(by_file, [CASE, "file_id"], "left_anti").join(by_document, [CASE, "document_id"], "left_anti")
        partitions.rewrite(kept.select(*self.schema.names), files.select(CASE), self.path, CASE)

    def delete_cases(self, cases: list[int]) -> None:
        """Removes the folders of these cases; nothing is read."""
        for case in cases:
            partitions.delete(self.spark, f"{self.path}/{CASE}={int(case)}")
