import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from casewright.llm import source_audit as audit

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "text", "lang_id", "term")])
LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plainly(rows, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LETTERS))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        everywhere = sum((counts[lang, s] for s in sources), Counter())

        def parts(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        q, p = parts(everywhere), {s: parts(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(b, sum((p[s][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in sources if b != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, parts=3, **kw):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in audit.source_divergence(docs, **kw).collect())


def some_rows(seed, n=300):
    r = random.Random(seed)
    words = ["the", "The", "a", "Ünder", "über", "日本", "x1y2z", "don't", "🙂", "ﬁ", "zz\x00zz", "É"] + ["".join(r.choice("abcé") for _ in range(r.randrange(1, 5))) for _ in range(60)]
    return [(r.choice(["en", "de", "", None]), r.choice(["s0", "s0", "s0", "s1", "é2", None]), " ".join(r.choice(words) for _ in range(r.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = some_rows(seed)
    assert found(spark, rows) == plainly(rows)


def test_bounds_of_tasks_change_nothing(spark, monkeypatch):
    rows = some_rows(3)
    for bound in ("_BYTES", "_LEAVES", "_CELLS", "_CANDIDATES"):
        monkeypatch.setattr(audit, bound, 5)
        docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(2)
        assert sorted(tuple(r) for r in audit.source_divergence(docs, top=7).collect()) == plainly(rows, 7)


def test_odd_tables(spark):
    assert found(spark, [("en", "a", "x")]) == []
    rows = [("en", "a", None), ("en", "b", ""), ("de", "c", "1 2 3"), ("fr", None, "mot"), ("fr", "", "mot mot"), ("fr", "z", "mot")]
    assert found(spark, rows) == plainly(rows)
    assert [r for r in plainly(rows) if r[0] == "en"] == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    docs = spark.createDataFrame([("en", "a", "x", "", "")], SCHEMA)
    assert audit.source_divergence(docs.where("false")).count() == 0
    rows = [("en", "a", "word " * 200_000 + "rare"), ("en", "b", "word rare"), ("en", "a", "rare word"), ("en", "c", "rare rare")] * 3
    assert found(spark, rows) == plainly(rows)


def test_many_batches_of_one_term(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = some_rows(4, 120)
        assert found(spark, rows, 8) == plainly(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_equals_a_dictionary():
    import pyarrow as pa

    r = random.Random(1)
    trie, want, row = audit.Trie(), defaultdict(list), 0
    for n in (1, 5, 300, 700, 2, 90):
        terms = sorted({bytes(r.choice(b"ab\xc3\xa9\xff") for _ in range(r.randrange(8))) for _ in range(n)} | {b"a" * k for k in (63, 64, 65, 200, 300)})
        shared = audit.shared_prefixes(pa.array([b"a", *terms], pa.binary())[1:])
        assert shared[1:] == [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(terms, terms[1:])]
        trie.add(terms, [0, *shared[1:]], range(row, row + len(terms)))
        for t in terms:
            want[t].append(row)
            row += 1
    assert list(trie.walk()) == sorted(want.items()) and trie.leaves == len(want)


def test_parts_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randrange(1, 1 << r.randrange(1, 46))
        n = r.randrange(total)
        assert audit.parts_of([n], total)[0] == 1 + 1_000_000_000 * (n + 1) // total
