import random
from functools import cache

from casewright.llm import line_dedup
from .test_simhash import brute_components


@cache
def shingles(line):
    return {line[i : i + 7] for i in range(max(1, len(line) - 6))}


def near(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def brute(rows):
    lines = sorted({((k is not None, k or 0), i, x, k) for k, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\f\r")})
    first = {}
    for _, i, x, k in lines:
        first.setdefault(x, (k, i))
    order = {x: n for n, x in enumerate(first)}
    names = list(first)
    root = brute_components(range(len(names)), lambda a, b: near(names[a], names[b]))
    return {(k, i): first[names[root[order[x]]]] for _, i, x, k in lines}


def corpus():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    line = lambda n: " ".join(r.choices(words, k=n))

    def edit(x):
        w = x.split(" ")
        w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    seeds = [line(n) for n in (3, 5, 9, 14, 16, 20, 40, 90, 200) for _ in range(3)]
    rows = [(k, "\n".join(r.choice([s, edit(s), edit(edit(s)), line(12), "", "ab"]) for s in r.choices(seeds, k=6))) for k in range(60)]
    crowd = line(30)
    return rows + [(100 + k, edit(crowd)) for k in range(60)] + [(300, None), (301, ""), (302, " \n\t"), (303, rows[5][1]), (304, "é" * 3 + "\n" + "日本" * 200), (305, "ab" * 30 + "\n" + "ab" * 900), (None, rows[7][1] + "\nnew line of a null id"), (306, line(20000))]


def test_classes_match_brute_force(spark, make_docs):
    rows = corpus()
    got = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(make_docs(rows)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    wrong = [k for k in want if (got[k].class_doc, got[k].class_line) != want[k]]
    assert len(wrong) <= 0.01 * len(want), wrong[:5]
    assert all(r.kept == ((r.class_doc, r.class_line) == k) for k, r in got.items())
    assert line_dedup.line_classes(make_docs([])).count() == 0


def test_texts_keep_one_line_of_each_class(spark, make_docs):
    rows = [(1, "an ordinary first line that stays here\nsecond line of the first document"), (2, "an ordinary first line that stays here\n\nown words only"), (3, "an ordinary first line that stays here"), (4, None), (5, ""), (6, "own words only"), (6, "own words only")]
    got = line_dedup.deduplicate_lines(make_docs(rows))
    assert got.columns == make_docs(rows).columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.where("doc_id <> 4").collect()) == [(1, rows[0][1], len(rows[0][1])), (2, "\nown words only", 15), (5, "", 0)]
    assert got.where("doc_id = 4").first().text is None


def test_bands_recall():
    r, hit, pairs = random.Random(3), 0, 0
    for n in (25, 60, 90, 120, 400, 1500):
        for _ in range(40):
            a = "".join(r.choice("abcdefghij ") for _ in range(n))
            b = list(a)
            for _ in range(max(1, n // 80)):
                b[r.randrange(n)] = "Z"
            b = "".join(b)
            if near(a, b):
                which, found = line_dedup.buckets_of([a, b])
                pairs += 1
                hit += bool(set(found[which == 0]) & set(found[which == 1]))
    assert pairs > 80 and hit >= 0.98 * pairs


def test_lines_at_one_place_of_different_texts_without_ids(spark, make_docs):
    from casewright.llm import line_dedup

    near = "a line about rivers and boats that is long enough to be compared well"
    a = "\n".join([near, "alpha", "beta", near + "s"])
    b = "\n".join(["gamma", "delta", "epsilon", "a unique line on quite another matter", "beta"])
    got = {r.text for r in line_dedup.deduplicate_lines(make_docs([(None, a), (None, b)])).collect()}
    assert got == {"\n".join([near, "alpha", "beta"]), b.removesuffix("\nbeta")}


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "left", "gone", "of", "hit", "d_id", "line", "sieve_bits"]
    rows = [(1, "a first line that is long enough\nand one more line to lose", *"abcdefg"), (2, "and one more line to lose\nthis one stays where it is", *"hijklmn"), (None, None, *"opqrstu")]
    got = line_dedup.deduplicate_lines(spark.createDataFrame(rows, names))
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[0], (2, "this one stays where it is", *"hijklmn"), rows[2]], key=str)


def test_a_crowd_of_near_copies_matches_brute_force(spark, make_docs):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(60)]
    seed = r.choices(words, k=40)
    rows = []
    for k in range(400):  # similarities on both sides of the threshold
        w = list(seed)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.class_doc for r in line_dedup.line_classes(make_docs(rows)).collect()}
    want = {k: c for (k, _), (c, _) in brute(rows).items()}
    assert 3 < len(set(want.values())) < 300
    assert sum(got[k] != c for k, c in want.items()) <= 0.01 * len(want)


def test_groups_of_any_size_give_all_components():
    import numpy as np

    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(80)]
    for n in (2, 3, 16, 17, 120):
        seeds = [r.choices(words, k=30) for _ in range(3)]
        lines = []
        for _ in range(n):
            w = list(r.choice(seeds))
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = r.choice(words)
            lines.append(" ".join(w))
        lines = sorted(set(lines))
        want = brute_components(range(len(lines)), lambda a, b: near(lines[a], lines[b]))
        ways = [line_dedup.linked_in_large(lines, 0.8)] + ([line_dedup.linked_in_small(lines, np.zeros(len(lines), np.int64), 0.8)] if n <= line_dedup.SET else [])
        for a, b in ways:
            pairs = set(zip(a.tolist(), b.tolist()))
            assert brute_components(range(len(lines)), lambda x, y: (x, y) in pairs or (y, x) in pairs) == want
            assert len(pairs) == len(lines) - len(set(want.values()))


def test_small_groups_are_counted_apart():
    import numpy as np

    a, b = "a line that stands in two groups", "a line that stands in two groups!"
    lines = [a, b, "something else entirely here", a, "nothing like the other one", b, a, b, "ab", "ab", "日本", ""]
    found = line_dedup.linked_in_small(lines, np.array([0, 0, 0, 1, 1, 2, 3, 3, 4, 4, 4, 4]), 0.8)
    assert [x.tolist() for x in found] == [[0, 6, 8], [1, 7, 9]]


def test_buckets_with_the_same_lines_are_one(spark):
    rows = [(b, k) for b in (1, 2, 3) for k in (10, 20, 30)] + [(1, 10)] * 5 + [(4, 10), (5, 10), (5, 20)] + [(b, k) for b in (6, 7) for k in range(100, 140)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = line_dedup.met_lines(spark.createDataFrame(rows, "bucket bigint, key bigint").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in got:
        groups.setdefault((r.meet, r.n), []).append(r.key)
    assert sorted((n, sorted(ks)) for (_, n), ks in groups.items()) == [(2, [10, 20]), (3, [10, 20, 30])] + [(40, list(range(100, 140)))] * 2


def test_a_bucket_beyond_a_block_is_split(spark, make_docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 32)
    monkeypatch.setattr(line_dedup, "SET", 4)
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(60)]
    seed, rows = r.choices(words, k=40), []
    for k in range(150):
        w = list(seed)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.class_doc for x in line_dedup.line_classes(make_docs(rows)).collect()}
    want = {k: c for (k, _), (c, _) in brute(rows).items()}
    assert sum(got[k] != c for k, c in want.items()) <= 0.01 * len(want)
