"""An inverted index of chunks by their terms, and BM25 scores from it.

Postings, document frequencies and lengths are aggregates; a query meets only the postings of its own terms, never
the texts. Scores are normalised by the most that a query's terms can give, so they lie between 0 and 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.sources import partitions

#: Saturation of repeated terms, and how much of a chunk's length counts.
K1, B = 1.2, 0.75
#: Scores are rounded to so many places, so that their order doesn't hang on that of a sum.
PLACES = 9
#: With so many of them at most, the terms of queries are held against those of all chunks where these are.
ASKED = 200_000
#: Of the tasks that postings are dealt out to, the parts that one task may count.
SHARE = 4
_CHUNK = ["application_id", "document_id", "chunk_index"]


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; repeated ones stay."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _asked(queries: DataFrame) -> DataFrame:
    """application_id, query, term: a term that a query repeats stands once."""
    return queries.select("application_id", "query", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def _tokens(chunks: DataFrame) -> DataFrame:
    return chunks.select(*_CHUNK, terms(F.col("text")).alias("terms"))


def _counted(tokens: DataFrame) -> DataFrame:
    """_CHUNK, size, term, n: a row's terms are counted where it is; rows of one chunk are not yet added up."""
    kinds = dict(tokens.dtypes)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            of, term = pc.list_parent_indices(batch.column("terms")), pc.list_flatten(batch.column("terms"))
            found = pa.table({"of": of, "term": term}).group_by(["of", "term"]).aggregate([([], "count_all")])
            rows = pa.table(batch.select([*_CHUNK, "size"])).take(found["of"])
            yield from rows.append_column("term", found["term"]).append_column("n", found["count_all"].cast(pa.int64())).to_batches()

    return tokens.select(*_CHUNK, F.size("terms").alias("size"), "terms").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in _CHUNK) + ", size int, term string, n bigint")


def _added_up(counted: DataFrame) -> DataFrame:
    return counted.groupBy(*_CHUNK, "size", "term").agg(F.sum("n").alias("n"))


@dataclass
class TextIndex:
    """postings: application_id, term, document_id, chunk_index, n (occurrences), size (terms of the chunk); frequencies: application_id, term, df; cases: application_id, n_chunks, mean."""

    postings: DataFrame
    frequencies: DataFrame
    cases: DataFrame
    #: Occurrences before they were dealt out by term, and to how many tasks; where the index was built just now.
    counted: tuple[DataFrame, int] | None = None

    @staticmethod
    def build(chunks: DataFrame, queries: DataFrame | None = None) -> TextIndex:
        """Of rows (application_id, document_id, chunk_index, text). A term's occurrences in a row are counted where it is; what is shuffled are postings, once, by case and term.

        An index for known queries alone (application_id, query) leaves out other terms' postings before they are shuffled,
        unless the queries have more than ASKED terms; sizes and means are those of all terms, so scores are the same.
        """
        tokens = _tokens(chunks)
        counted, n = _counted(tokens), partitions.parts(chunks)
        if queries is not None:
            wanted = _asked(queries).select("application_id", "term").distinct()
            if wanted.limit(ASKED + 1).count() <= ASKED:
                counted = counted.join(F.broadcast(wanted), ["application_id", "term"], "left_semi")
        cases = tokens.groupBy("application_id").agg(F.count("*").alias("n_chunks"), F.avg(F.size("terms")).alias("mean"))
        index = TextIndex.of(_added_up(counted.repartition(n, "application_id", "term")), cases)
        if queries is None and chunks.rdd.getNumPartitions() * SHARE < n:
            # A task holds the postings that it counts until they are dealt out, many times the bytes of their texts: these go to more tasks first.
            counted = _counted(_tokens(chunks.repartition(n, *_CHUNK)))
        index.counted = counted, n
        return index

    def write(self, path: str) -> TextIndex:
        """Under `path`, postings sorted by case and term in ranges, so that a search skips files and pages by their least and greatest terms.

        A common term's postings may take several ranges. Rows of one chunk are added up where sorting has put them side
        by side, so a task sorts its postings and holds no table of them besides.
        """
        order = ["application_id", "term", "document_id"]
        if self.counted:
            counted, n = self.counted
            same = Window.partitionBy(*order, "chunk_index", "size").orderBy("n")
            added = F.sum("n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            rows = counted.repartitionByRange(n, *order).withColumns({"n": added, "row": F.row_number().over(same)}).where("row = 1").drop("row")
        else:
            rows = self.postings.repartitionByRange(*order)
        rows.sortWithinPartitions("application_id", "term").write.parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        TextIndex.of(spark.read.parquet(f"{path}/postings"), self.cases).frequencies.write.parquet(f"{path}/frequencies")
        self.cases.write.parquet(f"{path}/cases")
        return TextIndex.read(spark, path)

    @staticmethod
    def of(postings: DataFrame, cases: DataFrame) -> TextIndex:
        return TextIndex(postings, postings.groupBy("application_id", "term").agg(F.count("*").alias("df")), cases)

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "frequencies", "cases")))

    def scores(self, queries: DataFrame) -> DataFrame:
        """application_id, query, document_id, chunk_index, text_score of the chunks that have a term of the query.

        queries: distinct (application_id, query). A term that a query repeats counts once; one that no chunk of the
        case has adds to the most that the query can give, so its score stays under 1.
        """
        keys, known, frequencies, sent = ["application_id", "term"], _asked(queries), self.frequencies, lambda df: df
        if known.limit(ASKED + 1).count() <= ASKED:
            sent = F.broadcast
            frequencies = frequencies.join(sent(known.select(*keys).distinct()), keys)
        df = F.coalesce("df", F.lit(0))
        weighted = known.join(frequencies, keys, "left").join(self.cases, "application_id").withColumn("idf", F.log1p((F.col("n_chunks") - df + 0.5) / (df + 0.5)))
        most = weighted.groupBy(F.col("application_id").alias("m_case"), F.col("query").alias("m_query")).agg((F.sum("idf") * (K1 + 1)).alias("most"))
        hits = self.postings.join(sent(weighted.select("application_id", "query", "term", "idf", "mean")), keys)
        share = F.col("idf") * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        sums = hits.groupBy("application_id", "query", "document_id", "chunk_index").agg(F.sum(share).alias("sum"))
        joined = sums.join(sent(most), (F.col("application_id") == F.col("m_case")) & (F.col("query") == F.col("m_query")))
        return joined.select("application_id", "query", "document_id", "chunk_index", F.round(F.col("sum") / F.col("most"), PLACES).alias("text_score"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best chunks of each query by text_score, with their position; ties go to the lower document and chunk."""
        best = Window.partitionBy("application_id", "query").orderBy(F.desc("text_score"), "document_id", "chunk_index")
        return self.scores(queries).withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
