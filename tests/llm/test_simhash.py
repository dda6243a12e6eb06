import random

import pytest
import xxhash

from casewright.llm import simhash
from casewright.llm.common import Scratch
from casewright.llm.components import connected_components


def brute_print(text):
    words = bytes(text or "", "utf-8").lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("crowd", [1, 40, 400])
def test_links_join_exactly_the_near_prints(spark, crowd):
    r = random.Random(8)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        seed = r.getrandbits(64)
        for _ in range(12):
            x = seed
            for _ in range(r.randrange(9)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    for _ in range(crowd):  # which share a half
        prints.add(r.getrandbits(64) & ~simhash.MASK | 0xABCD)
    for k in range(crowd // 2):  # and have near other halves
        x = 0x1234 << 32 | 0xABCD
        for _ in range(r.randrange(1, 7)):
            x ^= 1 << r.randrange(32, 64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = {x: x for x in signed} | {r.node: r.component for r in connected_components(simhash.links(df, Scratch(spark, "test"))).collect()}
    want = brute_components(signed, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    assert got == want


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (200, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {1000 + k: 1000 for k in range(50)} | {200: 100, 100: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, make_docs):
    base = "one two three four five six seven eight nine ten " * 30
    rows = [(9, base), (4, base.upper()), (7, base + "more"), (1, ""), (2, None), (3, " \t\n"), (5, "a"), (6, "a b"), (8, "Ä b c"), (8, "Ä b c"), (None, base), (10, "x y z " * 9000), (None, "only here alone")]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    prints = {(k, brute_print(t)) for k, t in rows}
    assert {(r.doc_id, r.fp & (1 << 64) - 1) for r in got} == prints
    parts = {}
    for k, f in prints:
        parts.setdefault(f, set()).add(k)
    roots = brute_components(sorted(parts), lambda a, b: bin(a ^ b).count("1") <= 3)
    for r in got:
        ids = {k for f, ks in parts.items() if roots[f] == roots[r.fp & (1 << 64) - 1] for k in ks if k is not None}
        assert r.component_id == min(ids, default=None)
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_different_texts_without_ids_or_with_one_id_all_stay(spark, make_docs):
    a, b, c = ("one two three four five six seven " * 9, "quite another text about boats and rivers " * 9, "third words on mountains in the snow " * 9)
    rows = [(None, a), (None, b), (None, b), (5, c), (5, "something else of its own again " * 9), (7, c), (None, c)]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one_of_each(make_docs(rows)).collect()), key=str)
    assert got == sorted({rows[0], rows[1], rows[3], rows[4]}, key=str)


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "row", "gone", "tie", "k_id", "m_mark", "sieve_key", "left"]
    rows = [(1, "one two three four five " * 9, *"abcdefg"), (2, "one two three four five " * 9, *"abcdefg"), (1, "one two three four five " * 9, *"zbcdefg"), (None, None, *"abcdefg")]
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, names))
    assert got.columns == names
    kept = got.collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, rows[0][1]), (None, None)} and len(kept) == 2


def test_maps_and_variants_tell_rows(spark):
    """Equal documents are one whatever else they hold, and which of them stays doesn't hang on how they are dealt."""
    rows = [(1, "some words of a text that repeats", {"k": str(i)}, f'{{"a": {i}}}') for i in range(6)] + [(2, "quite another text with other words", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,string>, j string").selectExpr("doc_id", "text", "m", "parse_json(j) AS v", "struct(m) AS s")
    got = [[(r.doc_id, str(r.m), r.v and str(r.v.toPython())) for r in simhash.keep_one_of_each(df.repartition(n)).collect()] for n in (1, 2, 5)]
    assert sorted(k for k, *_ in got[0]) == [1, 2] and sorted(got[0]) == sorted(got[1]) == sorted(got[2])
