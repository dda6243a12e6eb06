"""How the sources of each language diverge in their vocabulary.

Each partition counts its terms in byte tries, one for each language: edges are runs of bytes, and a leaf counts the
term's occurrences and documents for each source. Tries are read out in the order of their bytes, which is that of
UTF-8, and their leaves are dealt to prefix ranges and merged there, one term after another, so neither a trie nor a
vocabulary is ever in one place. What a range keeps goes on in blocks of terms in that order; from these, sums for
pairs of sources and the candidates of each source are streamed.

Numbers are exact: counts are whole, and quotients are taken in steps that fit 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

UNIT = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
#: Bounds of what a task holds: bytes of text made into counts at once, leaves of its tries, cells of pair sums, candidates.
_BYTES, _LEAVES, _CELLS, _CANDIDATES = 1 << 22, 300_000, 1 << 22, 1 << 20
#: Letters of terms: A to Z become small, other ASCII becomes 0, bytes of longer characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256))
_COUNTER = [("group", "<i8"), ("n", "<i8"), ("docs", "<i8")]


class Trie:
    """Byte trie with compressed edges. A node is [edge, rows of counters or None, nodes by their first byte or None]."""

    def __init__(self):
        self.root, self.leaves = [b"", None, None], 0

    def add(self, terms: list[bytes], shared: list[int], rows) -> None:
        """Adds sorted terms, each from the last node on the way to the one before it that lies within what they share."""
        way, depths = [self.root], [0]
        for term, known, row in zip(terms, shared, rows):
            while depths[-1] > known:
                way.pop()
                depths.pop()
            node, at, end = way[-1], depths[-1], len(term)
            while at < end:
                below = node[2] and node[2].get(term[at])
                if below is None:
                    below = [term[at:], None, None]
                    if node[2] is None:
                        node[2] = {}
                    node[2][term[at]] = below
                    node, at = below, end
                elif term.startswith(below[0], at):
                    node, at = below, at + len(below[0])
                else:
                    edge, same = below[0], 1
                    most = min(len(edge), end - at)
                    while same < most and edge[same] == term[at + same]:
                        same += 1
                    fork = [edge[:same], None, {edge[same]: below}]
                    below[0] = edge[same:]
                    node[2][term[at]] = fork
                    node, at = fork, at + same
                way.append(node)
                depths.append(at)
            if node[1] is None:
                node[1] = []
                self.leaves += 1
            node[1].append(row)

    def walk(self):
        """(term, rows) in the order of bytes."""
        todo = [(b"", self.root)]
        while todo:
            before, (edge, rows, below) = todo.pop()
            term = before + edge
            if rows is not None:
                yield term, rows
            if below:
                todo += [(term, below[c]) for c in sorted(below, reverse=True)]


def shared_prefixes(terms):
    """How many bytes each of the terms (a binary array) shares with the one before it."""
    import numpy as np

    offsets, out = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset :][: len(terms) + 1].astype(np.int64), np.zeros(len(terms), np.int64)
    data, sizes = np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.diff(offsets)
    pairs, most = np.arange(1, len(terms)), np.minimum(sizes[1:], sizes[:-1])
    for k in range(64):
        pairs = pairs[most[pairs - 1] > k]
        pairs = pairs[data[offsets[pairs] + k] == data[offsets[pairs - 1] + k]]
        out[pairs] += 1
        if not len(pairs):
            break
    for i in pairs.tolist():  # few terms are that long
        differ = np.flatnonzero(data[offsets[i] :][: most[i - 1]] != data[offsets[i - 1] :][: most[i - 1]])
        out[i] = differ[0] if len(differ) else most[i - 1]
    return out.tolist()


def summed(owner, counters):
    """(owner, counters): one counter for each owner and group, in this order."""
    import numpy as np

    order = np.lexsort((counters["group"], owner))
    owner, counters = owner[order], counters[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (counters["group"][1:] != counters["group"][:-1])
    starts, out = np.flatnonzero(first), counters[first]
    if len(starts):
        out["n"], out["docs"] = np.add.reduceat(counters["n"], starts), np.add.reduceat(counters["docs"], starts)
    return owner[first], out


def packed(counters, sizes):
    """Counters as one binary value for each of the sizes."""
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(sizes)]) * counters.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(counters).tobytes())])


def unpacked(column, kind):
    """(row, value) of all values packed in a binary column."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(column.to_pylist()), kind)


class Counts:
    """A task's tries, by language, and the counters that their leaves tell."""

    def __init__(self):
        self.tries, self.counters, self.starts, self.rows, self.size = {}, [], [], 0, 0

    def count(self, texts: list[bytes], langs, groups) -> None:
        """Adds documents; an empty term counts the documents of each group."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        letters = np.frombuffer(b"\0".join(texts).translate(_LETTERS), np.uint8)
        inside = letters != 0
        edges = np.diff(inside.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[inside].tobytes())]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        terms = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary.take(order)])
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(1, len(terms))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        document = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, bounds), prepend=0))
        kinds, kind = np.unique(np.stack([langs, groups]), axis=1, return_inverse=True)  # by language, then group
        names, lang = np.unique(kinds[0], return_inverse=True)

        # Occurrences of each term in each document, then sums by language, term and group.
        found, n = np.unique(document * len(terms) + place[coded.indices.to_numpy()], return_counts=True)
        document, term = np.concatenate([found // len(terms), np.arange(len(texts))]), np.concatenate([found % len(terms), np.zeros(len(texts), np.int64)])
        kind = kind.reshape(-1)[document]
        cell = (lang[kind] * len(terms) + term) * kinds.shape[1] + kind
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], np.concatenate([n, np.zeros(len(texts), np.int64)])[order]
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        counters = np.zeros(len(at), _COUNTER)
        counters["group"], counters["n"], counters["docs"] = kinds[1][cell[at] % kinds.shape[1]], np.add.reduceat(n, at), np.diff(at, append=len(cell))
        row = cell[at] // kinds.shape[1]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        row = row[first]
        for k, name in enumerate(names.tolist()):
            mine = np.arange(*np.searchsorted(row, [k * len(terms), (k + 1) * len(terms)]))
            own = terms.take(pa.array(row[mine] - k * len(terms)))
            self.tries.setdefault(name, Trie()).add(own.to_pylist(), shared_prefixes(own), (mine + self.rows).tolist())
        self.starts.append(first + self.size)
        self.counters.append(counters)
        self.rows, self.size = self.rows + len(first), self.size + len(counters)

    def leaves(self) -> int:
        return sum(t.leaves for t in self.tries.values())

    def out(self):
        """Batches of lang, term, counters, by language in the order of bytes; the tries are empty afterwards."""
        import numpy as np
        import pyarrow as pa

        counters = np.concatenate([np.zeros(0, _COUNTER), *self.counters])
        starts = np.concatenate([*self.starts, [self.size]])
        self.counters, self.starts = [], []
        for lang, trie in sorted(self.tries.items()):
            walk = trie.walk()
            while part := [x for _, x in zip(range(8192), walk)]:
                rows = np.array([r for _, rows in part for r in rows])
                owner = np.repeat(np.arange(len(part)), [len(rows) for _, rows in part])
                sizes = starts[rows + 1] - starts[rows]
                place = np.repeat(starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                owner, own = summed(np.repeat(owner, sizes), counters[place])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), lang)), pa.array([t for t, _ in part], pa.binary()), packed(own, np.bincount(owner, minlength=len(part)))], names=["lang", "term", "counters"])
        self.__init__()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, term, counters from rows (lang_id, group_id, text): the leaves of each partition's tries."""

    def run(batches):
        counts, texts, langs, groups, size = Counts(), [], [], [], 0
        for batch in batches:
            for text, lang, group in zip(batch.column(2), batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(text.as_buffer().to_pybytes())
                langs.append(lang)
                groups.append(group)
                size += len(texts[-1])
                if size >= _BYTES:
                    counts.count(texts, langs, groups)
                    texts, langs, groups, size = [], [], [], 0
                    if counts.leaves() >= _LEAVES:
                        yield from counts.out()
        if texts:
            counts.count(texts, langs, groups)
        yield from counts.out()

    return docs.select("lang_id", "group_id", "text").mapInArrow(run, "lang bigint, term binary, counters binary")


_ENTRY = [("term", "<i8"), ("group", "<i8"), ("n", "<i8")]


def merged(leaves: DataFrame, min_documents: int) -> DataFrame:
    """lang, terms, entries, sums: blocks of the terms that at least so many documents of their language have.

    Leaves lie sorted in ranges of prefixes and are merged term by term. entries: a term's occurrences in each group
    (term, group, n); sums: a block's occurrences in each group, and all its language's groups where the empty term is.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("lang", pa.int64()), ("terms", pa.list_(pa.field("element", pa.binary()))), ("entries", pa.binary()), ("sums", pa.list_(pa.field("element", pa.struct([("group", pa.int64()), ("n", pa.int64())]))))])

        def blocks(langs, terms, owner, counters):
            documents = np.zeros(len(terms), np.int64)
            np.add.at(documents, owner, counters["docs"])
            empty = np.fromiter((not t for t in terms), bool, len(terms))
            stays = (documents >= min_documents) | empty
            for lang in np.unique(langs[stays]).tolist():
                mine = np.flatnonzero(stays & ~empty & (langs == lang))
                number = np.full(len(terms), -1)
                number[mine] = np.arange(len(mine))
                kept = counters[number[owner] >= 0]
                entries = np.zeros(len(kept), _ENTRY)
                entries["term"], entries["group"], entries["n"] = number[owner[number[owner] >= 0]], kept["group"], kept["n"]
                known = counters[(empty & (langs == lang))[owner]]["group"]
                groups, at = np.unique(np.concatenate([entries["group"], known]), return_inverse=True)
                n = np.zeros(len(groups), np.int64)
                np.add.at(n, at[: len(entries)], entries["n"])
                sums = [{"group": g, "n": x} for g, x in zip(groups.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([[terms[i] for i in mine]], schema.field(1).type), pa.array([entries.tobytes()], pa.binary()), pa.array([sums], schema.field(3).type)], schema=schema)

        last = None  # a term whose leaves may go on in the next batch, and its counters
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, terms = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            owner, counters = unpacked(batch.column(2), _COUNTER)
            if last:
                langs, terms = np.concatenate([[last[0]], langs]), [last[1], *terms]
                owner, counters = np.concatenate([np.zeros(len(last[2]), np.int64), owner + 1]), np.concatenate([last[2], counters])
            new = np.ones(len(terms), bool)
            new[1:] = (langs[1:] != langs[:-1]) | np.fromiter((a != b for a, b in zip(terms, terms[1:])), bool, len(terms) - 1)
            at = np.flatnonzero(new)
            owner, counters = summed((np.cumsum(new) - 1)[owner], counters)
            langs, terms, closed = langs[at], [terms[i] for i in at], owner < len(at) - 1
            last = (langs[-1], terms[-1], counters[~closed])
            yield from blocks(langs[:-1], terms[:-1], owner[closed], counters[closed])
        if last:
            yield from blocks(np.array([last[0]]), [last[1]], np.zeros(len(last[2]), np.int64), last[2])

    ranged = leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ranged.mapInArrow(run, "lang bigint, terms array<binary>, entries binary, sums array<struct<group: bigint, n: bigint>>")


def parts_of(n, total):
    """1 + floor(UNIT * (n + 1) / total) in 64 bits, for numbers under 2 ** 46."""
    import numpy as np

    high, rest = np.divmod((np.asarray(n) + 1) * 100_000, total)
    return 1 + high * 10_000 + rest * 10_000 // total


def divergence(p, q):
    return (p - q) * (p - q) // q


def pair_sums(terms, sources, p, base, n_terms: int):
    """For each source a row of sums over all terms of its divergence from each source.

    (terms, sources, p): the entries with occurrences, by term; base: p of each source where it has none. Only entries
    differ from the base, so the work is that of entries times sources, not terms times pairs.
    """
    import numpy as np

    full = np.broadcast_to(base, (n_terms, len(base))).copy()
    full[terms, sources] = p
    for a in range(len(base)):
        rest = divergence(base[a], base)
        row = rest * n_terms
        mine = sources == a
        has = np.zeros(n_terms, bool)
        has[terms[mine]] = True
        other = ~has[terms]
        np.add.at(row, sources[other], divergence(base[a], p[other]) - rest[sources[other]])
        if mine.any():
            row += (divergence(p[mine][:, None], full[terms[mine]]) - rest).sum(0)
        yield a, row


def best_terms(values, terms, k: int):
    """Places of the k highest values, ties by the bytes of their terms."""
    import numpy as np

    if len(values) <= k:
        return np.arange(len(values))
    least = np.partition(values, len(values) - k)[len(values) - k]
    above, ties = np.flatnonzero(values > least), np.flatnonzero(values == least)
    return np.concatenate([above, sorted(ties.tolist(), key=lambda i: terms[i])[: k - len(above)]]).astype(np.int64)


def streamed(blocks: DataFrame, top: int) -> DataFrame:
    """lang, source, part, item, value of blocks with their language's sources: sums of pairs, and each task's best candidates."""
    schema = "lang string, source string, part string, item string, value bigint"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums, best, held, named = {}, {}, 0, {}

        def batch_of(lang, source, part, items, values):
            n, names = len(values), named[lang][1]
            return pa.RecordBatch.from_arrays([pa.array([named[lang][0]] * n, pa.string()), pa.array([names[source]] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

        def pairs(lang, a, row):
            others = [b for b in range(len(row)) if b != a]
            return batch_of(lang, a, "pair", [named[lang][1][b] for b in others], row[others])

        def candidates():
            for (lang, source), (values, terms) in best.items():
                at = best_terms(values, terms, top)
                yield batch_of(lang, source, "term", [terms[i].decode() for i in at], values[at])
            best.clear()

        for batch in batches:
            for block in batch.to_pylist():
                lang, terms, entries = block["lang_id"], block["terms"], np.frombuffer(block["entries"], _ENTRY)
                known = np.array([s["group"] for s in block["sources"]])
                size = np.array([s["n"] for s in block["sources"]], np.int64)
                named[lang] = (block["lang"], [s["source"] for s in block["sources"]])
                total = size + block["n_terms"]
                order = np.argsort(known)
                source = order[np.searchsorted(known, entries["group"], sorter=order)]
                p = parts_of(entries["n"], total[source])
                # A lang without terms has no parts: its pairs are sums over nothing.
                base = parts_of(np.zeros(len(size), np.int64), np.maximum(total, 1))
                for a, row in pair_sums(entries["term"], source, p, base, len(terms)):
                    if len(base) ** 2 > _CELLS:
                        yield pairs(lang, a, row)
                    else:
                        if lang not in sums:
                            sums[lang] = np.zeros((len(base), len(base)), np.int64)
                        sums[lang][a] += row
                if sum(len(m) ** 2 for m in sums.values()) > 4 * _CELLS:
                    yield from (pairs(of, a, row) for of, m in sums.items() for a, row in enumerate(m))
                    sums.clear()
                if not len(terms):
                    continue
                everywhere = np.zeros(len(terms), np.int64)
                np.add.at(everywhere, entries["term"], entries["n"])
                q = parts_of(everywhere, size.sum() + block["n_terms"])[entries["term"]]
                value, names = divergence(p, q), np.array(terms, object)
                for s in np.unique(source[p > q]).tolist():
                    at = np.flatnonzero((source == s) & (p > q))
                    before = best.get((lang, s), (np.zeros(0, np.int64), np.zeros(0, object)))
                    values, found = np.concatenate([before[0], value[at]]), np.concatenate([before[1], names[entries["term"][at]]])
                    if len(values) > 8 * top:
                        at = best_terms(values, found, top)
                        values, found = values[at], found[at]
                    held += len(values) - len(before[0])
                    best[lang, s] = values, found
                if held > _CANDIDATES:
                    yield from candidates()
                    held = 0
        yield from candidates()
        yield from (pairs(lang, a, row) for lang, m in sums.items() for a, row in enumerate(m))

    return blocks.mapInArrow(run, schema)


def numbered_groups(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """lang, source, lang_id, group_id of all groups, and the seed of their hashes, tried until no two share one."""
    for seed in range(100):
        groups = scratch.put(docs.select("lang", "source", *ids(seed)).distinct())
        n = groups.agg(F.count("*"), F.countDistinct("group_id"), F.countDistinct("lang"), F.countDistinct("lang_id")).first()
        if n[0] == n[1] and n[2] == n[3]:
            return groups, seed
    raise ValueError("no seed tells the groups apart")


def ids(seed: int) -> list:
    return [F.xxhash64(F.lit(seed), "lang").alias("lang_id"), F.xxhash64(F.lit(seed), "lang", "source").alias("group_id")]


def source_divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others and from all of them.

    Terms are runs of letters A to Z, made small, and of characters beyond ASCII; a language keeps those that at least
    `min_documents` of its rows have. Of its V kept terms, a group of n occurrences (a source, or the whole language)
    gives a term with c occurrences there p = 1 + floor(UNIT * (c + 1) / (n + V)). Part `pair`: each other source with
    the sum of floor((p - q) ** 2 / q) over the kept terms, q its p. Part `term`: the kept terms that the source has
    and gives more than the language's q, by the same value, up to rank `top`. Values descend, ties go by the items'
    UTF-8. Null texts, languages and sources count as empty ones; rows that repeat count as often; sources without
    terms have pairs too. Other columns aren't read; an empty table gives no rows.
    """
    base = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    scratch = Scratch(docs.sparkSession, "audit")
    groups, seed = numbered_groups(base, scratch)
    leaves = scratch.put(count_terms(base.select(*ids(seed), "text")))
    blocks = scratch.put(merged(leaves, min_documents))
    scratch.drop(leaves)
    sizes = blocks.select(F.explode("sums").alias("s")).groupBy("s.group").agg(F.sum("s.n").alias("n"))
    terms = blocks.groupBy(F.col("lang").alias("v_lang")).agg(F.sum(F.size("terms")).alias("n_terms"))
    sources = groups.join(sizes, F.col("group_id") == F.col("group")).groupBy("lang_id", "lang").agg(F.sort_array(F.collect_list(F.struct("source", F.col("group_id").alias("group"), "n"))).alias("sources"))
    known = scratch.put(sources.join(terms, F.col("lang_id") == F.col("v_lang")).drop("v_lang"))
    found = streamed(blocks.select(F.col("lang").alias("b_lang"), "terms", "entries").join(known, F.col("b_lang") == F.col("lang_id")).drop("b_lang"), top)
    found = scratch.put(found)
    scratch.drop_all_but(found)
    order = lambda *keys: Window.partitionBy("lang", "source", *keys).orderBy(F.desc("value"), "item")
    pair = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order()))
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= top)
    return pair.unionByName(term)
