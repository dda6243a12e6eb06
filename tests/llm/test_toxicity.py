import math
import random
import re

from casewright.llm import toxicity as tox
from casewright.llm.toxicity import FEATURES, Matcher


def marks(text, patterns={"idiot": 1.0}):
    return {m: round(v, 6) for m, v in Matcher(patterns).sums(text).items() if v}


def test_contexts_mark_matches():
    assert marks("an idiot") == {"I": 1}
    assert marks("You are an idiot.") == {"Iy": 1}
    assert marks("You are not an idiot.") == {"Iyn": 1}
    assert marks("You a b c d e idiot") == {"I": 1}
    assert marks("she said it was quite an idiot") == {"Ir": 1}
    assert marks("not a b c idiot") == {"I": 1} and marks("not, idiot") == {"I": 1}
    assert marks("kill them") == {"T": 1, "Z": 1} and marks("you kill") == {"Ty": 1}
    assert marks("they will not be killing you") == {"Fyn": 1, "Zn": 1}
    assert marks("we are going to really hurt you, he threatened") == {"F": 1, "Z": 1, "Ty": 1}
    assert marks("she said it was " + "word " * 100 + "quite an idiot") == {"Ir": 1}
    assert marks("idiotic, IDIOT; xidiot") == {"I": 2}
    assert marks(None) == marks("") == marks("nothing here") == {}


def interpreted(symbols):
    """The rules themselves, read off the symbols around each place."""
    kinds, struck = list(symbols), set()
    for i, s in enumerate(symbols):
        near = symbols[max(0, i - 3) : i]
        if s == "T" and "W" in near:
            kinds[i] = "F"
        if s == "Y" and "T" in near and "Y" not in near[len(near) - near[::-1].index("T") :]:
            kinds[i] = "Z"
            struck.add(i)
    out = []
    for i, s in enumerate(kinds):
        if s in "ITFZ":
            before = kinds[:i]
            s += "y" * any(x in "YZ" for x in before[-4:]) + "n" * ("N" in before[-3:]) + "r" * ("R" in before)
        out.append("O" if s == "W" else s)
    return out


def test_grammar_equals_its_rules():
    r, whole = random.Random(1), tox.grammar()
    for _ in range(3000):
        symbols = [r.choice("ITYNROW") for _ in range(r.randrange(14))]
        state, got = whole.start, []
        for s in symbols:
            state, out = whole.arcs[(state, s)]
            got.append(out)
        assert got == interpreted(symbols), symbols


def test_composition_equals_running_one_after_another():
    r, parts = random.Random(1), [tox.threats(), tox.scope("YZ", "y", 4), tox.scope("N", "n", 3), tox.scope("R", "r", None)]
    whole = tox.grammar()
    for _ in range(300):
        symbols = [r.choice("ITYNROW") for _ in range(r.randrange(12))]
        one, states, state, each = [], [p.start for p in parts], whole.start, []
        for s in symbols:
            state, out = whole.arcs[(state, s)]
            one.append(out)
            for k, p in enumerate(parts):
                states[k], s = p.step(states[k], s)
            each.append(s)
        assert one == each


def test_long_text_is_read_to_its_end():
    assert marks("word " * 50_000 + "\nyou idiot") == {"Iy": 1}


def test_features_add_up_kinds_and_contexts():
    found = dict(zip(FEATURES, Matcher({"idiot": 2.0}).features("You are not an idiot. She said an idiot will kill them")))
    assert {f: round(math.expm1(v), 6) for f, v in found.items()} == {"I": 4, "T": 0, "F": 1, "Z": 1, "y": 4, "n": 2, "r": 4}


def held_out_results(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.train(docs, labels)
    got = {r.doc_id: r for r in tox.score(docs, model).collect()}
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got.values())
    fold = {r.doc_id for r in docs.where(tox.held_out(docs.doc_id)).collect()}
    return model, [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if r.doc_id in fold]


def test_held_out_recall_precision_and_signs(spark):
    model, rows = held_out_results(spark, "sf0.1")
    hits = rows.count((1, 1))
    assert sum(t for t, _ in rows) > 80
    assert hits >= 0.9 * sum(t for t, _ in rows) and hits >= 0.9 * sum(p for _, p in rows)
    weights = dict(zip(FEATURES, model.weights))
    assert all(weights[f] > 0 for f in "ITFZy") and weights["n"] < 0 and weights["r"] < 0

    def of(text):
        return tox._scores(model, Matcher(model.patterns), [type("Text", (), {"as_py": lambda self: text})()])[0]

    plain = of("what an idiot")
    assert of("you are an idiot") > plain > of("he is called, not an idiot")
    assert of("they reported quite an idiot") < plain and of("that is not an idiot") < of("that is an idiot")
    assert of("we will kill you") > max(0.5, of("we will not kill you"), of("he said we will kill you")) and of("they kill time") > of("nothing of that kind") == of("")


def test_held_out_accuracy_of_few_rows(spark):
    _, rows = held_out_results(spark, "sf0.01")
    assert rows and sum(t == p for t, p in rows) >= 0.95 * len(rows)


def test_no_pattern_is_learned_from_chance(spark, make_docs):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = [(k, k % 10 == 0, " ".join(r.choices(words, k=60)) + (" dreadful" if k % 10 == 0 and k % 30 else "")) for k in range(600)]
    training = spark.createDataFrame([(k, t, int(y)) for k, y, t in rows], "row long, text string, toxic int")
    assert {p.rstrip("$") for p in tox.learn_patterns(training)} <= {"dreadful"[:n] for n in range(4, 9)} and tox.learn_patterns(training)


def test_fit_keeps_signs_and_stated_weights():
    n = len(FEATURES)
    weights, _ = tox.fit_weights([[0.0] * n] * 10, [0, 1] * 5)
    assert [round(w, 3) for w in weights] == [v[0] for v in FEATURES.values()]
    one = [[1.0 if f in "In" else 0.0 for f in FEATURES]] * 50 + [[1.0 if f == "I" else 0.0 for f in FEATURES]] * 50
    weights, _ = tox.fit_weights(one + [[0.0] * n] * 100, [1] * 50 + [0] * 50 + [0] * 100)  # negated insults are toxic, others not
    assert dict(zip(FEATURES, weights))["n"] == -0.3


def test_odd_tables(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    docs = make_docs([(1, "bad words " * 3), (2, None), (3, ""), (None, "x"), (3, "")])
    assert tox.score(docs, tox.train(docs, labels)).count() == 5
    none = tox.train(docs, labels.limit(0))
    assert [(r.score, r.predicted) for r in tox.score(docs, none).collect()] == [(0.0, 0)] * 5
    assert tox.score(docs.limit(0), none).count() == 0


def test_folds_by_crc(spark, make_docs):
    import zlib

    docs = make_docs([(k, "") for k in range(40)])
    for r in docs.withColumn("h", tox.held_out(docs.doc_id)).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert re.fullmatch("[a-z]+", tox.THREATS[0])


def test_beginnings_count_once_a_row(spark):
    import re

    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abÉ") for _ in range(r.randrange(1, 13))) for _ in range(40)) for _ in range(30)] + [None, "", "abcd ABCD abcde abcd"]
    want = {}
    for t in texts:
        words = {w for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if len(w) >= 4}
        for p in {w[:n] for w in words for n in tox.PREFIXES if len(w) >= n} | {w + "$" for w in words}:
            want[p] = want.get(p, 0) + 1
    rows = tox._prefixes(spark.createDataFrame([(t,) for t in texts], "text string")).groupBy("p").count().collect()
    assert {x.p: x["count"] for x in rows} == want
