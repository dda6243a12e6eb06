"""Fuzzy line deduplication by MinHash over character shingles.

Equal lines are one node from the start. Signatures are banded with high recall (a pair at the threshold is
missed about once in 1,700 times, closer pairs far less); colliding pairs are verified by their exact Jaccard
similarity; union-find over the links keeps one line of each component, the one with the least (doc_id, line).

Sets under SMALL shingles get classic signatures of one permutation a value; larger ones share one permutation
cut into as many bins, empty bins borrowing from others. A pair at the threshold differs in size by a fifth at
most, so sizes from LARGE to SMALL get both and no pair falls between the schemes.

All lines of a bucket are compared, by counts of common shingles that an index over the bucket gives, and only the
links that join its components leave the task, fewer than the bucket has lines. Buckets of up to SET lines that hold
the same lines are one; those of more than BLOCK lines are dealt as pairs of blocks. So no pair that shares a bucket
goes uncompared, no pair is spelled out as a row, and a task holds two blocks of lines at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_sieve, sieve, unused
from .components import connected_components

SHINGLE = 7
THRESHOLD = 0.8
BANDS = 14
ROWS = 4
SMALL, LARGE = 100, 80
#: Characters for which signatures and counts are made at once: arrays of this length stay in a core's cache.
_CHARS = 131_072
#: Buckets of up to SET lines are told by these, in larger ones lines are counted one after another; larger ones than BLOCK lines are split.
SET, BLOCK = 16, 4096


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def with_digest(lines: DataFrame) -> DataFrame:
    return lines.withColumn("digest", F.unhex(F.md5("line")))


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, columns of `keep`, line_no (from 0), line, of lines with other than white space."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"\S"))


def hashed(text: str):
    """64-bit hashes of the SHINGLE (seven) characters from each place on."""
    import numpy as np

    one = np.uint64
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    two = codes[:-1] * one(0x9E3779B97F4A7C15) + codes[1:]
    four = two[:-2] * one(0xD6E8FEB86659FD93) + two[2:]
    return (four[:-3] ^ (four[:-3] >> one(32))) * one(0xBF58476D1CE4E5B9) + four[3:]


def buckets_of(lines: list[str], bands: int = BANDS, rows: int = ROWS):
    """(index of the line, bucket) arrays of all lines' bucket hashes."""
    import numpy as np

    n_values, one = bands * rows, np.uint64
    r = np.random.Generator(np.random.PCG64(20240229))
    odd, flips = (r.integers(1, 1 << 63, n_values, dtype=np.uint64) | one(1) for _ in range(2))
    borrow = r.integers(0, n_values, (400, n_values))

    def mix(x):
        x = (x ^ (x >> one(31))) * one(0x7FB5D329728EA185)
        x = (x ^ (x >> one(27))) * one(0x81DADEF4BC2DD44D)
        return x ^ (x >> one(33))

    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.array([len(x) for x in padded])
    h = hashed("".join(padded))
    h = mix(h)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(lines)), sizes)
    place = np.arange(len(h))
    inside = np.flatnonzero(place + SHINGLE <= ends.take(owner[: len(h)]))  # places are taken faster than a mask is
    # The upper 40 bits of each hash, after the line's number: sorted, a line's distinct shingles stand in order.
    key = np.sort((owner.take(inside).astype(np.uint64) << one(40)) | (h.take(inside) >> one(24)))
    key = key.take(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])))
    line, value = (key >> one(40)).astype(np.int64), key & one((1 << 40) - 1)
    counts = np.bincount(line, minlength=len(lines))
    starts = np.concatenate([[0], np.cumsum(counts)])

    found_line, found = [], []

    def emit(which, signature, scheme):
        for b in range(bands):
            x = np.full(len(which), one(scheme * 1000 + b), np.uint64)
            for c in range(b * rows, (b + 1) * rows):
                x = mix(x * one(0x9E3779B97F4A7C15) + signature[:, c])
            found_line.append(which)
            found.append(x)

    small = np.flatnonzero(counts < SMALL)
    if len(small):
        own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in small])
        cuts, x = np.concatenate([[0], np.cumsum(counts[small])[:-1]]), value[own]
        signature = np.empty((len(small), n_values), np.uint64)
        for c in range(n_values):
            signature[:, c] = np.minimum.reduceat((x ^ flips[c]) * odd[c], cuts)
        emit(small, signature, 1)
    large = np.flatnonzero(counts >= LARGE)
    if len(large):
        row = np.full(len(lines), -1)
        row[large] = np.arange(len(large))
        bins = ((value * one(n_values)) >> one(40)).astype(np.int64)
        first = np.flatnonzero(np.diff(line * n_values + bins, prepend=-1))
        at = row.take(line.take(first))
        first, at = first[at >= 0], at[at >= 0]
        cell = at * n_values + bins.take(first)
        signature, filled = np.zeros(len(large) * n_values, np.uint64), np.zeros(len(large) * n_values, bool)
        signature[cell], filled[cell] = value.take(first) + one(1), True
        signature, filled = signature.reshape(-1, n_values), filled.reshape(-1, n_values)
        source, known = signature.copy(), filled.copy()
        for turn in borrow:
            empty = ~filled
            if not empty.any():
                break
            a, b = np.nonzero(empty & known[:, turn])
            signature[a, b], filled[a, b] = source[a, turn[b]], True
        emit(large, signature, 2)
    return np.concatenate(found_line), np.concatenate(found).view(np.int64)


def line_buckets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, bucket: each bucket of each line; a line that several partitions hold has them as many times."""

    def run(batches):
        import re

        import numpy as np
        import pyarrow as pa
        import xxhash

        word, seen, lines, keys, chars = re.compile(r"[^ \t\n\x0b\f\r]"), set(), [], [], 0

        def out():
            which, found = buckets_of(lines)
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)[which]), pa.array(found)], names=["key", "bucket"])

        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if not word.search(line):
                        continue
                    key = xxhash.xxh64_intdigest(line.encode(), 42)
                    if key in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    lines.append(line)
                    keys.append(key)
                    chars += len(line)
                    if chars >= _CHARS:
                        yield out()
                        lines, keys, chars = [], [], 0
        if lines:
            yield out()

    return docs.select(F.col(text_col)).mapInArrow(run, "key bigint, bucket bigint")


def shingle_hashes(line: str):
    """The sorted 64-bit hashes of a line's distinct shingles; a shorter line is one shingle."""
    import numpy as np

    h = np.sort(hashed(line.ljust(SHINGLE, "\0")))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def met_lines(buckets: DataFrame) -> DataFrame:
    """meet, n, key: the different keys of each bucket (bucket, key) with at least two, n of them.

    Buckets with up to SET keys have their keys' hash for `meet`, so that equal ones are one; others their own.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def mixed(x):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(29))

        def out(bucket, key, closed):
            """Rows of whole buckets, and the last one's bucket and keys unless it is closed."""
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(first, append=len(key))
            rest = len(key) if closed else first[-1]
            left = np.unique(key[rest:])
            several = np.flatnonzero(np.repeat(sizes > 1, sizes)[:rest])  # few of them
            bucket, key, last = bucket.take(several), key.take(several), bucket[-1]
            order = np.lexsort((key, bucket))
            bucket, key = bucket.take(order), key.take(order)
            new = np.ones(len(key), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
            bucket, key = bucket[new], key[new]
            first = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else np.zeros(0, np.int64)
            sizes = np.diff(first, append=len(key))
            sums = np.add.reduceat(mixed(key.view(np.uint64)), first) if len(key) else np.zeros(0, np.uint64)
            meet = np.where(sizes <= SET, mixed(sums ^ sizes.astype(np.uint64)).view(np.int64), bucket[first])
            whole = np.repeat(sizes > 1, sizes)
            rows = pa.RecordBatch.from_arrays([pa.array(np.repeat(meet, sizes)[whole]), pa.array(np.repeat(sizes, sizes)[whole]), pa.array(key[whole])], names=["meet", "n", "key"])
            return rows, np.full(len(left), last), left

        bucket = key = np.zeros(0, np.int64)
        for batch in batches:
            bucket, key = (np.concatenate([x, c.to_numpy()]) for x, c in zip((bucket, key), batch.columns))
            if len(key):
                rows, bucket, key = out(bucket, key, False)
                yield rows
        if len(key):
            yield out(bucket, key, True)[0]

    # By one whole number Spark sorts its digits, by two it compares rows.
    ordered = buckets.select("bucket", "key").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "meet bigint, n bigint, key bigint").distinct()


def _near(common, size_a, size_b, threshold: float):
    return common >= threshold * (size_a + size_b - common)


def linked_in_small(lines: list[str], groups, threshold: float):
    """(a, b) of lines that join all near lines of each group; groups: of each line, in order. All groups, of fewer than 2 ** 20 lines, are counted at once."""
    import numpy as np

    chars = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    spans = np.array([len(x) - SHINGLE + 1 for x in chars])
    owner = np.repeat(np.arange(len(lines)), spans)
    starts = np.cumsum([0, *(len(x) for x in chars)])[:-1]
    h = hashed("".join(chars))[np.arange(len(owner)) + np.repeat(starts - np.cumsum(spans) + spans, spans)]
    # The upper 44 bits of each shingle's hash, mixed with its group, before its line's number: sorted, equal shingles
    # of a group stand together, their lines in order.
    low = np.uint64((1 << 20) - 1)
    mixed = (h ^ (groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).take(owner)) * np.uint64(0xBF58476D1CE4E5B9)
    key = np.sort((mixed & ~low) | owner.astype(np.uint64))
    key = key.take(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])))
    key, owner = key >> np.uint64(20), (key & low).astype(np.int64)
    sizes, found = np.bincount(owner, minlength=len(lines)), []
    for step in range(1, SET):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        found.append(owner[same] * len(lines) + owner[same + step])
    pair, common = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    a, b = pair // len(lines), pair % len(lines)
    near = _near(common, sizes[a], sizes[b], threshold)
    a, b, part, before = a[near], b[near], np.arange(len(lines)), None
    while before is None or (part != before).any():  # the least line of each component, over paths of SET lines at most
        before = part.copy()
        np.minimum.at(part, b, part[a])
        np.minimum.at(part, a, part[b])
    joined = np.flatnonzero(part != np.arange(len(lines)))
    return part[joined], joined


def linked_in_large(lines: list[str], threshold: float):
    """(a, b) of near pairs that join the components of one group: for each line in turn the common shingles with all before it are counted by postings."""
    import numpy as np

    shingles = [shingle_hashes(x) for x in lines]
    sizes = np.array([len(x) for x in shingles])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, term = np.unique(np.concatenate(shingles), return_inverse=True)
    order = np.argsort(term, kind="stable")
    lines = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(term))])
    rank = np.empty(len(order), np.int64)  # how many lines before have the shingle
    rank[order] = np.arange(len(order)) - starts[term[order]]
    ends, part, found = np.cumsum(sizes), np.arange(len(sizes)), []
    for k in range(1, len(sizes)):
        own = slice(ends[k] - sizes[k], ends[k])
        n = rank[own]
        places = np.repeat(starts[term[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(lines[places], minlength=k)
        near = np.flatnonzero(_near(common, sizes[:k], sizes[k], threshold))
        # One link to each component around; these become one.
        around, one = np.unique(part[near], return_index=True)
        found += [(i, k) for i in near[one].tolist()]
        if len(around):
            part[k] = around[0]
            if len(around) > 1:
                part[:k][np.isin(part[:k], around[1:])] = around[0]
    return np.array(found, np.int64).reshape(-1, 2).T


def links(groups: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: near lines of each group that join all its near lines; rows (meet, i, j, n, digest, line), one for each line of a group.

    Sets are compared by hashes of their shingles, of 64 bits, and of 44 in groups of up to SET lines.
    """

    def run(batches):
        import itertools

        import numpy as np
        import pyarrow as pa

        def rows():
            for batch in batches:
                yield from zip(zip(*(c.to_pylist() for c in batch.columns[:3])), *(c.to_pylist() for c in batch.columns[3:]))

        def out(digests, pairs):
            return pa.RecordBatch.from_arrays([pa.array([digests[i] for i in side.tolist()], pa.binary()) for side in pairs], names=["a", "b"])

        digests, lines, of, n_groups, chars = [], [], [], 0, 0
        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
            group = list(group)
            if len(group) > SET:
                yield out([r[2] for r in group], linked_in_large([r[3] for r in group], threshold))
                continue
            for _, _, digest, line in group:
                digests.append(digest)
                lines.append(line)
                of.append(n_groups)
                chars += len(line)
            n_groups += 1
            if chars >= _CHARS:
                yield out(digests, linked_in_small(lines, np.array(of), threshold))
                digests, lines, of, chars = [], [], [], 0
        if digests:
            yield out(digests, linked_in_small(lines, np.array(of), threshold))

    place = ["meet", "i", "j"]
    return groups.select(*place, "n", "digest", "line").repartition(*place).sortWithinPartitions(*place, "digest").mapInArrow(run, "a binary, b binary")


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line_no, key, class_doc, class_line, kept: one row for each line that has other than white space.

    A line's class is its component's least (doc_id, line_no), nulls first; kept marks that line itself. Rows of
    `docs` that repeat an id and a text are one document: each has the same lines kept. Null and empty texts
    and blank lines give no rows. Other columns aren't read.
    """
    return _classes(docs, id_col, text_col, threshold).drop("of")


def _linked(lines: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """digest, root: the component of each distinct line that is linked to another."""
    met = scratch.put(met_lines(line_buckets(docs)))
    # Lines that meet others get their texts once; a line is told by its digest, of which two may share a key.
    keys = met.select("key").distinct()
    slots = scratch.put(sieve(met, "key"))
    wanted = in_sieve(nodes, F.col("key"), slots, "hit").where("hit").join(keys, "key", "left_semi")
    wanted = wanted.select(F.col("key").alias("w_key"), F.col("digest").alias("w_digest"), "node")
    same = (F.col("key") == F.col("w_key")) & (F.col("digest") == F.col("w_digest")) & (F.col("line_no") == F.col("node.line_no")) & (F.col("of") == F.col("node.of"))
    sifted = with_digest(in_sieve(lines.drop("digest"), F.col("key"), slots, "hit").where("hit"))
    found = sifted.join(wanted, same & F.col("doc_id").eqNullSafe(F.col("node.doc_id")))
    texts = scratch.put(found.dropDuplicates(["digest"]).select("key", "digest", "line"))

    # A bucket of more than BLOCK lines is a grid of pairs of blocks, in which a line stands in its row and column.
    half = F.ceil(F.col("n") * 2 / BLOCK).cast("int")
    own = F.when(F.col("n") > BLOCK, F.pmod(F.xxhash64("digest"), half).cast("int")).otherwise(0)
    every = F.when(F.col("n") > BLOCK, F.sequence(F.lit(0), half - 1)).otherwise(F.array(F.lit(0)))
    placed = met.join(texts, "key").withColumn("own", own).withColumn("other", F.explode(every))
    pairs = links(placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}), threshold)
    return connected_components(pairs, "lines").withColumnsRenamed({"node": "digest", "component": "root"})


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """line_classes with `of`, the hash of the line's whole text: with its id it tells a document, also where ids repeat or are null."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("of", F.xxhash64("text"))
    lines = with_digest(explode_lines(docs, keep=("of",)).withColumn("key", line_key(F.col("line"))))
    scratch = Scratch(docs.sparkSession, "lines")
    nodes = scratch.put(lines.groupBy("key", "digest").agg(F.min(F.struct("doc_id", "line_no", "of")).alias("node")))
    linked = scratch.put(_linked(lines, nodes, docs, threshold, scratch).withColumnRenamed("digest", "l_digest"))
    scratch.drop_all_but(nodes, linked)

    rooted = scratch.put(nodes.join(linked, F.col("digest") == F.col("l_digest")).select("digest", "root", "node"))
    least = rooted.groupBy("root").agg(F.min("node").alias("class"))
    moved = rooted.join(least, "root").select(F.col("digest").alias("m_digest"), "class")
    classes = scratch.put(nodes.join(moved, F.col("digest") == F.col("m_digest"), "left").select("digest", F.coalesce("class", "node").alias("class")))
    scratch.drop_all_but(classes)
    own = lines.select("doc_id", "of", "line_no", "key", "digest").join(classes, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("line_no") == F.col("class.line_no")) & (F.col("of") == F.col("class.of"))
    return own.select("doc_id", "of", "line_no", "key", F.col("class.doc_id").alias("class_doc"), F.col("class.line_no").alias("class_line"), kept.alias("kept"))


def deduplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with only the kept lines (and blank ones) in their texts, and n_chars, if there is one, of the new text.

    A document whose lines are all kept elsewhere goes; one without any such line at all (null, empty, blank)
    stays as it is. Only documents that lose a line (and few more, which a sieve can't tell from them) are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    dropped = _classes(docs, id_col, text_col, threshold).where(~F.col("kept")).groupBy("doc_id", "of").agg(F.collect_set("line_no").alias("gone"))
    dropped = scratch.put(dropped)
    hit, gone, left, d_id, d_of = unused(docs, "hit", "gone", "left", "d_id", "d_of")
    slots = sieve(dropped.select("of"), "of")
    sifted = in_sieve(docs, F.xxhash64(text_col), slots, hit)
    lists = dropped.select(F.col("doc_id").alias(d_id), F.col("of").alias(d_of), F.col("gone").alias(gone))
    joined = sifted.where(hit).join(lists, F.col(id_col).eqNullSafe(F.col(d_id)) & (F.xxhash64(text_col) == F.col(d_of)), "left")
    split = F.split(F.col(text_col), "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    out = joined.withColumn(left, F.when(F.col(gone).isNotNull(), F.transform(stays, lambda i: F.get(split, i))))
    out = out.where(F.col(gone).isNull() | F.exists(left, lambda x: x.rlike(r"\S")))
    changed = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    columns = {text_col: changed} | ({"n_chars": F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(changed)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return sifted.where(~F.col(hit)).select(docs.columns).union(out.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns)))
