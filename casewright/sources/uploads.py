"""Uploaded documents: binary files of a bounded size under a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.display import extension, secure_filename, stem

#: Larger files are refused.
MAX_BYTES = 100 << 20


def scan_uploads(spark: SparkSession, path: str, kind: str = ".pdf", content: bool = False) -> DataFrame:
    """original_filename, stored_name, size, file_type of the files of that extension up to MAX_BYTES; with their content if asked for.

    A stored name is the safe stem, a hash of the whole path in place of a random identifier, and the extension.
    Sizes are filtered before contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{kind}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stored = F.concat(F.md5("path"), F.lit("_"), secure_filename(stem(name)), extension(name))
    wanted = files.where(F.col("length") <= MAX_BYTES)
    return wanted.select(name.alias("original_filename"), stored.alias("stored_name"), F.col("length").alias("size"), F.lit("document").alias("file_type"), *(["content"] if content else []))
