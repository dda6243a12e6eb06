import hashlib
import random

from casewright.llm import order_minhash as om


def test_sketch_is_sensitive_to_order_and_repeats():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    half = " ".join(words[:200] + words[:0:-1][:200])
    swapped = " ".join(words[200:] + words[:200])
    s = om.sketch(text)
    assert om.likeness(s, om.sketch(text)) == 1
    light = om.likeness(s, om.sketch(text.replace(words[100], "zzzzzz")))
    assert light > 0.85
    assert om.likeness(s, om.sketch(swapped)) < light  # the same k-mers in another order
    assert om.likeness(s, om.sketch(half)) < light
    assert om.likeness(s, om.sketch(" ".join("".join(r.choice("qrstuvwxyz") for _ in range(6)) for _ in range(400)))) < 0.1
    assert om.written(om.sketch("ab " * 50)) != om.written(om.sketch("ab " * 51))
    assert om.likeness(om.sketch(""), om.sketch(None)) == 1 and om.likeness(om.sketch(""), om.sketch("a")) == 0
    assert set(om.written(om.sketch(""))) == {"."}


def plain_sketch(text):
    """The definition in whole numbers: number k-mers by occurrence, hash, keep the least two of each range in text order, hash these."""
    full = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    if not text:
        return [-1] * 64
    text = text.ljust(5, "\0")
    seen, found = {}, []
    for at in range(len(text) - 4):
        h = 0
        for c in text[at : at + 5]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & full
        kmer = mix(h) >> 24
        n = seen[kmer] = seen.get(kmer, -1) + 1
        found.append((mix((kmer * 0xD6E8FEB86659FD93 + n) & full) >> 24, at))
    width, out = (1 << 40) // 64, []
    for b in range(64):
        least = sorted(x for x in found if b * width <= x[0] < (b + 1) * width)[:2]
        value = b + 1
        for h, _ in sorted(least, key=lambda x: x[1]):
            value = (value * 0x9E3779B97F4A7C15 + h) & full
            value ^= value >> 29
        out.append(((value * 0xBF58476D1CE4E5B9) & full) >> 48 if least else -1)
    return out


def test_sketch_equals_its_definition():
    r = random.Random(3)
    for n in (0, 1, 4, 5, 6, 30, 300, 3000):
        for alphabet in ("ab", "abcdefgh é日🙂", "a"):
            text = "".join(r.choice(alphabet) for _ in range(n))
            assert om.sketch(text).tolist() == plain_sketch(text)


def test_documents_against_brute_force(spark, make_docs):
    r = random.Random(9)
    rows = [(k, "".join(r.choice("ab cé日") for _ in range(r.randrange(200)))) for k in r.sample(range(-50, 500), 60)]
    rows += [(1000, None), (1001, ""), (1002, "long " * 20_000), (None, "no id"), (rows[0][0], rows[0][1])]
    got = om.order_fingerprints(make_docs(rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    want = []
    for i, (k, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        s, es = om.sketch(t), om.sketch(e)
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), om.written(s), om.written(es), om.likeness(s, es), om.likeness(s, om.sketch(nxt))))
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got)


def test_one_and_no_document(spark, make_docs):
    (x,) = om.order_fingerprints(make_docs([(5, "abcdefghi")])).collect()
    assert (x.near_next, x.edited_sha256) == (1.0, hashlib.sha256(b"abcdefabc").hexdigest())
    assert om.order_fingerprints(make_docs([])).count() == 0
