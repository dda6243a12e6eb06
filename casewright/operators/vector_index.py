"""An inverted file of vectors: lists around centroids, searched by probing a few, or exactly by bounds that rule lists out.

Centroids are fitted on a bounded sample; every vector is then put into the list of its nearest centroid. For each
case and list the largest distance to the centroid is known, so that no vector of the list can have a higher inner
product with q than q.c + |q| * radius. The exact search probes the best lists, takes each query's k-th score, and
reads only lists that may still hold something as good; what it skips cannot be among the k best.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, chosen by a hash of their ids; how many centroids at most; rounds of fitting.
SAMPLE, LISTS, ROUNDS = 20_000, 64, 10
PROBES = 8
#: Bounds are widened by this much, relative to their parts, for what rounding may take from them.
_SLACK = 1e-9


def fit_centroids(vectors: DataFrame, n: int = LISTS, sample: int = SAMPLE):
    """At most n centroids (a matrix) by Lloyd's rounds over at most `sample` rows (document_id, vector); seeds are rows spread over the sample."""
    import numpy as np

    rows = vectors.select(F.xxhash64("document_id").alias("h"), "vector").orderBy("h").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.vector for r in rows], float)
    seeds = np.unique(x, axis=0)
    centroids = seeds[np.linspace(0, len(seeds) - 1, min(n, len(seeds))).astype(int)]
    for _ in range(ROUNDS):
        nearest = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


@dataclass
class VectorIndex:
    """entries: application_id, document_id, list, vector; lists: application_id, list, n, radius; centroids: at most LISTS rows, on the driver."""

    entries: DataFrame
    lists: DataFrame
    centroids: object

    @staticmethod
    def build(vectors: DataFrame, path: str, n: int = LISTS, sample: int = SAMPLE) -> VectorIndex:
        """Writes the index of rows (application_id, document_id, vector; vectors of one length, without nulls) under `path`: files by list, cases together, so that a search reads only the lists it probes."""
        import numpy as np

        centroids = fit_centroids(vectors, n, sample)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.array(batch.column(2).to_pylist(), float)
                nearest = ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)
                away = np.sqrt(((x - centroids[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(away)], names=["application_id", "document_id", "vector", "list", "away"])

        rows = vectors.select("application_id", "document_id", F.col("vector").cast("array<double>").alias("vector"))
        kinds = dict(rows.dtypes)
        placed = rows.mapInArrow(run, f"application_id {kinds['application_id']}, document_id {kinds['document_id']}, vector array<double>, list int, away double")
        placed.repartitionByRange("list", "application_id").sortWithinPartitions("list", "application_id").write.partitionBy("list").parquet(f"{path}/entries")
        spark = vectors.sparkSession
        spark.createDataFrame([], placed.schema).write.parquet(f"{path}/schema")  # an empty index has no files by list
        read = spark.read.schema(placed.schema).parquet(f"{path}/entries")
        read.groupBy("application_id", "list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).write.parquet(f"{path}/lists")
        spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
        return VectorIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> VectorIndex:
        import numpy as np

        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most LISTS
        entries = spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/entries")
        return VectorIndex(entries, spark.read.parquet(f"{path}/lists"), np.array([r.centroid for r in rows], float))

    def _bounded(self, queries: DataFrame) -> DataFrame:
        """The queries with the bound of each list of their case: at most LISTS rows for each."""
        import numpy as np

        centroids = self.centroids

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows or not len(centroids):
                    continue
                q = np.array(batch.column(2).to_pylist(), float)
                near = q @ centroids.T
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.field("element", pa.float64()))), pa.array(np.sqrt((q**2).sum(1)))], names=["application_id", "query", "vector", "near", "norm"])

        rows = queries.select("application_id", "query", F.col("vector").cast("array<double>").alias("vector"))
        near = rows.mapInArrow(run, f"application_id {dict(rows.dtypes)['application_id']}, query string, vector array<double>, near array<double>, norm double")
        reach = F.abs(F.get("near", F.col("list"))) + F.col("norm") * F.col("radius")
        bound = F.get("near", F.col("list")) + F.col("norm") * F.col("radius") + _SLACK * (1 + reach)
        return near.join(self.lists, "application_id").select("application_id", "query", F.col("vector").alias("asked"), "list", bound.alias("bound"))

    def _scored(self, probes: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return self.entries.join(probes, ["application_id", "list"]).select("application_id", "query", "document_id", product.alias("score"))

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """application_id, query, document_id, score, position: the k best documents of each query's case, ties to the lower document.

        queries: application_id, query, vector, of distinct (application_id, query). Not exact: only the lists with
        the highest bounds are read, `probes` for each query, so that good ones may be missed.
        """
        order = Window.partitionBy("application_id", "query").orderBy(F.desc("bound"), "list")
        ranked = self._bounded(queries).withColumn("turn", F.row_number().over(order))
        best = Window.partitionBy("application_id", "query").orderBy(F.desc("score"), "document_id")
        first = self._scored(ranked.where(F.col("turn") <= probes)).withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
        if not exact:
            return first
        least = first.groupBy(F.col("application_id").alias("a"), F.col("query").alias("q")).agg(F.min("score").alias("least"), F.count("*").alias("n"))
        same = F.col("application_id").eqNullSafe(F.col("a")) & F.col("query").eqNullSafe(F.col("q"))
        more = ranked.where(F.col("turn") > probes).join(least, same, "left").where(F.coalesce((F.col("n") < k) | (F.col("bound") >= F.col("least")), F.lit(True)))
        found = first.drop("position").unionByName(self._scored(more.select("application_id", "query", "asked", "list")))
        return found.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
