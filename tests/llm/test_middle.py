import hashlib
import random
import re

from casewright.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    one, two = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:one], units[one:two], units[two:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_units_by_gaps_equal_units_by_matching():
    r, automaton = random.Random(1), middle.event_automaton()
    for _ in range(2000):
        text = "".join(r.choice(" \t\n\x0b\f\rab é  🙂<P>SM") for _ in range(r.randrange(20)))
        n, place, marked = middle.unit_ends(automaton, text)
        units = UNIT.findall(text)
        assert n == len(units) and marked == bool(re.search("<[PSM]>", text))
        assert [place(k) for k in range(n + 1)] == [len("".join(units[:k])) for k in range(n + 1)], repr(text)


def test_outputs_equal_the_definition_and_are_restored(spark, make_docs):
    r = random.Random(2)
    texts = [None, "", " ", "a", "<P> b", "x <S>", "<M>", "a<S", ">b <P", "<<P", "\n\n", "é " * 30_000 + "end", "word " * 100_000]
    texts += ["".join(r.choice(" \n\tab🙂é<>PSM") for _ in range(r.randrange(60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b c"), (7, "a<S"), (7, "other text here"), (-3, "minus three")]
    docs = make_docs(rows)
    out = middle.restored(middle.fill_in_middle(docs)).collect()
    got = sorted(((x.doc_id, x.text, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in out), key=str)
    assert got == sorted(((k, t or "", *plainly(k, t)) for k, t in rows), key=str)
    assert {x.form for x in out} == {"plain", "psm", "spm"}


def test_every_form_where_all_are_cut(spark, make_docs):
    texts = ["", "<S", "a<", "<P<S", " > ", "S>M>", "<S<P<M"] * 20
    out = middle.restored(middle.fill_in_middle(make_docs(list(enumerate(texts))), cut=100, suffix_first=50)).collect()
    assert all(x.text == texts[x.doc_id] for x in out) and {x.form for x in out} == {"plain", "psm", "spm"}


def test_empty_table(spark, make_docs):
    empty = make_docs([(1, "a")]).where("false")
    assert middle.restored(middle.fill_in_middle(empty)).count() == 0
