import random
import re
from collections import Counter

from casewright.llm import quality

GAP = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    lines, seen, dup = [x for x in text.split("\n") if GAP.sub("", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_metrics_match_brute_force(spark, make_docs):
    r = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x " * 50, "a\nb\na\n\na", "é ü\x0bß | <#>", "q w e r " * 3000, "\na b\r\n"]
    texts += ["".join(r.choice(["a ", "b ", "c ", "\n", "the ", "# "]) for _ in range(r.randrange(60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(5, "twice a b"), (5, "twice a b"), (None, "of the end")]
    got = quality.judge(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id is not None and x.doc_id != 5:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(texts[x.doc_id]), repr(texts[x.doc_id])
            assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
            assert x.kept == (not x.base_failed)  # no language has enough words for a reference here
    assert quality.judge(make_docs([])).count() == 0


def test_junk_is_rejected_and_prose_kept(spark, make_docs):
    r = random.Random(4)
    prose = lambda: " ".join(r.choice(["the", "of", "and", "to", "in", "boat", "river", "slowly", "went", "green", "stone", "asked"]) + r.choice(["", "", "", ","]) for _ in range(200)).capitalize() + "."
    junk = lambda: " ".join(r.choice(["BUY", "NOW", "CHEAP", "DEAL", "CLICK"]) + str(r.randrange(99)) + "$$%" for _ in range(200))
    rows = [(k, prose()) for k in range(90)] + [(k, junk()) for k in range(90, 100)]
    got = {x.doc_id: x.kept for x in quality.judge(make_docs(rows)).collect()}
    assert [got[k] for k in range(100)] == [True] * 90 + [False] * 10


def test_plan_has_no_python(spark, make_docs):
    plan = quality.base_metrics(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)
