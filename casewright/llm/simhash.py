"""SimHash near-duplicates by ball hashing that meets in the middle.

Two 64-bit fingerprints with at most 3 differing bits agree up to 1 bit, half the radius, in one of their 32-bit
halves. So for either half every fingerprint emits its own value and all variants with one bit flipped, and
these are shuffled: the other fingerprint of a pair has one of them as its value. Under a key that is some
value and that another fingerprint meets, the other halves meet in the same way: values emit all variants of
their other half within 2 bits, and the key's variants their other half as it is. Around each such spot, the
values within 1 bit and the key's variants are its centres; all at the spot are linked to the least centre.

Every link is verified on all 64 bits, and is within the radius: a centre is 1 bit from the spot, or from the key,
and anything else there 2 bits at most. Every pair within the radius shares a spot that has a centre, so the
components are those of all pairs. The rows grow with the fingerprints that meet, never with their pairs, at
any size of a crowd. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_sieve, shuffle_partitions, sieve, unused
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
MASK = (1 << 32) - 1


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of word shingles, as a signed integer."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    half, sums = len(hashes), np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, half, 1 << 16):
        sums += np.unpackbits(packed[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * sums > half).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit) of each whole text; words are split at ASCII white space, A-Z lower-cased."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _ball(value: Column, bits: int) -> Column:
    """The 32-bit value, then all others within `bits` (1 or 2) flipped bits."""
    masks = [0, *(1 << i for i in range(32)), *(1 << i | 1 << j for i in range(32) for j in range(i) if bits > 1)]
    return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: value.bitwiseXOR(m))


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join up all pairs within RADIUS bits, and no others."""
    # Fingerprints are few bytes and make many rows, so they are dealt over all partitions; planned sizes don't know
    # how many rows a value makes, so joins of these are told to merge.
    nodes = nodes.select("fp").repartition(shuffle_partitions(nodes.sparkSession), "fp")
    low, high = F.col("fp").bitwiseAND(MASK), F.shiftrightunsigned("fp", 32)
    halves = nodes.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("own"), high.alias("rest")), F.struct(F.lit(1).alias("side"), high.alias("own"), low.alias("rest")))).alias("h")).select("fp", "h.*")
    keyed = halves.select("fp", "side", "rest", F.posexplode(_ball(F.col("own"), 1)).alias("flip", "key"))
    keyed = keyed.select("fp", "side", "key", "rest", (F.col("flip") > 0).alias("variant"))
    # A key matters if some fingerprint has it as its value and another meets it; most keys have one row and end here.
    shared = keyed.groupBy("side", "key").agg(F.count("*").alias("n"), F.min("variant").alias("alone")).where((F.col("n") > 1) & ~F.col("alone")).select("side", "key")
    shared = scratch.put(shared)
    slots = sieve(shared.select(F.xxhash64("side", "key").alias("k")), "k")
    met = scratch.put(in_sieve(keyed, F.xxhash64("side", "key"), slots, "hit").where("hit").drop("hit").join(shared.hint("merge"), ["side", "key"]))

    # Role 1 is a centre within 1 bit, 2 a value at 2 bits, 3 a variant of the key, which is a centre at its own rest.
    wide = met.where(~F.col("variant")).select("fp", "side", "key", F.explode(_ball(F.col("rest"), 2)).alias("at"), "rest")
    wide = wide.select("fp", "side", "key", "at", F.when(F.bit_count(F.col("rest").bitwiseXOR(F.col("at"))) < 2, 1).otherwise(2).alias("role"))
    close = met.where("variant").select("fp", "side", "key", F.col("rest").alias("at"), F.lit(3).alias("role"))
    spots = wide.union(close)
    hubs = spots.groupBy("side", "key", "at").agg(F.min(F.when(F.col("role") != 2, F.col("fp"))).alias("hub"), F.count("*").alias("n")).where(F.col("hub").isNotNull() & (F.col("n") > 1)).drop("n")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS
    found = spots.join(hubs.hint("merge"), ["side", "key", "at"]).where((F.col("fp") != F.col("hub")) & near)
    return found.select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id reachable over links of at most RADIUS bits; one row for each row.

    Texts without words have fingerprint zero and link like any other. Nulls count as empty texts; a null id is
    never a component's id unless all its ids are null. Repeated rows are one node. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(fingerprints(docs, id_col=id_col, text_col=text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(nodes, scratch), "simhash")
    scratch.drop_all_but(prints)
    roots = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    linked = roots.where(F.col("root").isNotNull())
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = linked.join(smallest, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(of_print, prints.fp == F.col("of")).select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that are their component's least by id and text; nulls go last.

    A row is told by its id and text: rows that repeat both are one and one of them stays, the least by its other
    columns' hash, whatever these hold (maps and variants by their JSON), but different texts that share an id, or have none, are rows of their own. What goes is chosen
    in narrow columns; only rows that a sieve can't tell from those are shuffled with their texts.
    """
    row, gone, hit, own = unused(docs, "row", "gone", "hit", "own")
    others = [F.to_json(F.struct(c)) if any(x in kind for x in ("map", "variant")) else F.col(c) for c, kind in docs.dtypes if c != text_col]
    mark = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), F.xxhash64(*others).alias("tie"))
    marked = docs.withColumn(row, mark)
    scratch = Scratch(docs.sparkSession, "simhash")
    found = near_duplicates(marked, id_col=row, text_col=text_col)
    # Rows that are equal in all of these are told by nothing: one of them stays, by dropDuplicates.
    counted = scratch.put(found.groupBy(F.col("doc_id").alias("mark")).agg(F.count("*").alias("n"), F.min("component_id").alias("least")))
    touched = counted.where((F.col("n") > 1) | (F.col("mark") != F.col("least"))).select(F.col("mark").alias(own), (F.col("mark") != F.col("least")).alias(gone))
    slots = sieve(touched.select(F.xxhash64(own).alias("k")), "k")
    sifted = in_sieve(marked, F.xxhash64(row), slots, hit)
    told = sifted.where(hit).join(touched, F.col(row) == F.col(own), "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    return sifted.where(~F.col(hit)).select(docs.columns).union(told.dropDuplicates([row]).select(docs.columns))
