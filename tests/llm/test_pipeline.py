import random

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa

import corpus_pipeline as cp
from casewright.llm import quality, simhash, toxicity
from casewright.llm.common import materialize, table

from .test_line_dedup import brute, near
from .test_quality import brute as base
from .test_simhash import brute_components, brute_print
from .test_tokens import whole

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    matcher, before, columns = toxicity.Matcher(model.patterns), {r.doc_id: r.text for r in docs.collect()}, docs.columns
    for name, stage in cp.STAGES[:4]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and after.keys() <= before.keys()
        if name == "toxicity":
            assert after == {k: t for k, t in before.items() if model.bias + np.dot(model.weights, matcher.features(t)) < 0}
        elif name == "quality":
            con = duckdb.connect()
            con.register("documents", pa.Table.from_pylist([{"doc_id": r.doc_id, "lang": r.lang, "text": r.text} for r in rows_before]))
            assert after.keys() == {k for (k,) in con.execute(f"SELECT doc_id FROM ({quality.oracle_sql()}) WHERE kept").fetchall()}
            assert not {k for k, t in before.items() if (m := base(t))[0] < 50 or 100 * m[4] > 50 * m[0]} & after.keys()
        elif name == "line_dedup":
            classes = brute(list(before.items()))
            want = {}
            for k, t in before.items():
                left = [x for i, x in enumerate(t.split("\n")) if classes.get((k, i), (k, i)) == (k, i)]
                if any(x.strip() for x in left):
                    want[k] = "\n".join(left)
            assert {k for k in want.keys() | after.keys() if want.get(k) != after.get(k)} == set()
            assert all(r.n_chars == len(r.text) for r in rows)
        else:
            prints = {k: brute_print(t) for k, t in before.items()}
            root = brute_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= simhash.RADIUS)
            assert after == {k: before[k] for k in before if root[k] == k}
        before, rows_before = after, rows
    pieces = {}
    for r in cp.pack(spark, docs, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {k: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for k, p in pieces.items()} == {k: whole(P.path("byte_bpe_50k.json"), t) + [1] for k, t in before.items()}
    assert near("same line", "same line")


def test_odd_rows_pass_through(spark, make_docs):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choices(words, k=n)) + "."
    same = prose(90)
    rows = [(1, None), (2, ""), (3, same), (3, same), (3, prose(90)), (None, prose(90)), (None, prose(90)), (4, " \n"), (5, prose(9000))]
    docs = make_docs(rows).drop("start", "ids")
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    packed = docs.groupBy("doc_id").count().collect()
    assert {r.doc_id for r in packed} == {3, 5, None} and docs.where("start = 0").count() == 5
    empty = make_docs([])
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_filters_keep_columns_of_any_name_and_repeated_rows(spark):
    names = ["doc_id", "text", "lang", "row", "g_id", "words", "n", "score", "kept", "tie"]
    prose = "a plain text of some words that nobody minds, " * 2 + " ".join(f"word{k}" for k in range(60))
    rows = [(1, prose, "en", *"abcdefg"), (1, prose, "en", *"abcdefg"), (None, prose, None, *"hijklmn"), (2, None, "en", *"opqrstu")]
    docs = spark.createDataFrame(rows, names)
    model = toxicity.Model({"idiot": 1.0}, [5.0] * len(toxicity.MARKS), -2.0)
    for got, want in ((quality.keep_documents(docs), rows[:3]), (toxicity.keep_documents(docs, model), rows)):
        assert got.columns == names
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
