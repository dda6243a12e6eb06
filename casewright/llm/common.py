"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources.storage import scratch_path

#: A sieve has 2 ** SIEVE_BITS slots, 64 to a row, whatever it is made of: 262,144 rows of two numbers at most.
SIEVE_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables of one run in the shared folder: each cuts lineage, outlives lost executors and goes when dropped.

    A table may be dropped once everything that reads it has been written itself.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.n = spark, scratch_path(spark, tag), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.path}/{self.n}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*(t for k, (t, _) in list(self.paths.items()) if k not in kept))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """One table of a Scratch of its own, for results that are read later."""
    return Scratch(df.sparkSession, tag).put(df)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of `df` has them, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """word, bits: which of the slots some key (bigint) falls into; of bounded size, so that it may be broadcast.

    Of rows with other keys it lets through about the share of filled slots; with far more keys than slots that is
    all of them. So it only spares work before an exact join.
    """
    slot = F.col(column).bitwiseAND((1 << SIEVE_BITS) - 1)
    slots = keys.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("bit"))
    return slots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def in_sieve(rows: DataFrame, key: Column, slots: DataFrame, name: str) -> DataFrame:
    """The rows with a boolean column `name`: their key's slot is filled. A null key is in none."""
    k, word, bits = unused(rows, "sieve_key", "sieve_word", "sieve_bits")
    slots = slots.select(F.col("word").alias(word), F.col("bits").alias(bits))
    joined = rows.withColumn(k, key.bitwiseAND((1 << SIEVE_BITS) - 1)).join(F.broadcast(slots), F.shiftright(F.col(k), 6) == F.col(word), "left")
    hit = F.expr(f"shiftright(`{bits}`, cast(`{k}` & 63 as int)) & 1") == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop(k, word, bits)
