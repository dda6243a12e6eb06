"""Tables that a stream of changes keeps up to date, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.sources import partitions
from casewright.sources.storage import scratch_path

#: Parts of a table by its key's hash: a batch rewrites those that it changes.
BUCKETS = 32
#: Tasks that share a bucket while it is rewritten.
SPLIT = 4


def bucket(keys: list[str], n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("bucket")


class KeyedTable:
    """Rows by key under `path`; of the rows of a key the one with the greatest `order` counts, then the greatest by its other values."""

    def __init__(self, path: str, schema, keys: list[str], order: str, buckets: int = BUCKETS):
        self.path, self.schema, self.keys, self.order, self.buckets = path, schema, keys, order, buckets

    def read(self, spark) -> DataFrame:
        return self._stored(spark).drop("bucket")

    def _stored(self, spark) -> DataFrame:
        schema = self.schema.fieldNames()
        if not partitions.exists(spark, self.path):
            return spark.createDataFrame([], self.schema).withColumn("bucket", bucket(self.keys, self.buckets))
        full = spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0)).schema
        return spark.read.schema(full).parquet(self.path).select(*schema, "bucket")

    def merge(self, changes: DataFrame) -> None:
        """Takes in rows; those that are older than, or equal to, what is stored change nothing, so a batch that is repeated writes nothing.

        The rows and what their buckets hold are dealt out once, by bucket, written once beside the table, and the
        folders of buckets in which something changed take the place of the table's. Files also tell which rows changed.
        """
        spark, names = changes.sparkSession, self.schema.fieldNames()
        new = changes.select(*names).withColumn("bucket", bucket(self.keys, self.buckets))
        asked = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as buckets
        if not asked:
            return
        stored = self._stored(spark).where(F.col("bucket").isin(asked)).select(*names, "bucket").withColumn("_known", F.lit(True))
        part = F.pmod(F.hash(*self.keys), F.lit(SPLIT))
        dealt = stored.unionByName(new.withColumn("_known", F.lit(False))).withColumn("_part", part).repartition(self.buckets * SPLIT, "bucket", "_part")
        rank = F.struct(self.order, *(n for n in names if n != self.order))
        last = dealt.groupBy("bucket", "_part", *self.keys).agg(F.max(rank).alias("_last"), F.max(F.when(F.col("_known"), rank)).alias("_before"))
        changed = (F.col("_before").isNull() | (F.col("_last") > F.col("_before"))).alias("_changed")
        staged = scratch_path(spark, "merge")
        last.select(*(F.col(f"_last.{n}").alias(n) for n in names), changed, "bucket").write.partitionBy("bucket").parquet(staged)
        touched = spark.read.schema("_changed boolean, bucket int").parquet(staged).where("_changed").select("bucket").distinct()
        for row in touched.collect():
            partitions.replace(spark, f"{staged}/bucket={row.bucket}", f"{self.path}/bucket={row.bucket}")
        partitions.delete(spark, staged)

    def follow(self, changes: DataFrame, checkpoint: str) -> None:
        """Merges what a stream has now, a micro-batch at a time, and ends."""
        changes.writeStream.foreachBatch(lambda rows, _: self.merge(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_changes(events: DataFrame) -> DataFrame:
    """What each indexing event (id, seq, event, chunks_count, error_message, at) makes of its file's row.

    started clears what a run before left; completed tells the chunks, failed the message; both end the run.
    """
    event = F.col("event")
    return events.select(
        "id",
        "seq",
        F.when(event == "started", "indexing").when(event == "completed", "completed").when(event == "failed", "error").otherwise("pending").alias("indexing_status"),
        F.when(event == "completed", F.col("chunks_count")).otherwise(0).alias("chunks_count"),
        F.when(event == "failed", F.coalesce("error_message", F.lit(""))).alias("error_message"),
        F.when(event.isin("completed", "failed"), F.col("at")).alias("completed_at"),
    )
