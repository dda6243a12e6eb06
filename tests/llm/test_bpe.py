import hashlib
import random

import public_tokenizers as P
import tiktoken

from casewright.llm import bpe, queries
from casewright.llm.tokens import UnitEncoder  # noqa: F401

from .test_tokens import ODD, random_texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_pieces_are_merged_exactly():
    encoder, r = bpe.PieceEncoder(RANKS), random.Random(11)
    tokens = list(RANKS)
    pieces = [bytes(r.choice(b"aabcdehinorst \xc3\xa9") for _ in range(r.randrange(1, 60))) for _ in range(1500)]
    pieces += [b"".join(r.choices(tokens, k=r.randrange(1, 5))) for _ in range(1500)] + [b"a" * 3000, b"ab" * 999, bytes(range(256))]
    for piece in pieces:
        want = [RANKS[piece]] if piece in RANKS else [RANKS[x] for x in bpe.merged(RANKS, piece)]
        assert encoder.encode(piece) == want, piece


def test_documents_match_tiktoken(spark, make_docs):
    rows = list(enumerate(ODD + random_texts(200))) + [(900, None), (901, "long word " * 4000), (901, "long word " * 4000), (None, "x")]
    encoded = bpe.encode_documents(make_docs(rows), PATH, P.PATTERN)
    got = bpe.decode_documents(encoded, PATH).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == OWN.encode_ordinary(text), repr(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.decode_documents(bpe.encode_documents(make_docs([]), PATH, P.PATTERN), PATH).count() == 0


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op5_byte_bpe(spark, sf).collect()}
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, r = OWN.encode_ordinary(doc.text), got[doc.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()


def test_neighbours_agree_by_the_definition():
    """Taking merges back says of any two tokens what merging their bytes says, and also where ranks don't rise."""
    r = random.Random(5)
    for ranks in (RANKS, {t: (k if len(t) == 1 else 60_000 - k) for k, t in enumerate(sorted(RANKS, key=RANKS.get)) if len(t) < 4}):
        encoder = bpe.PieceEncoder(ranks)
        assert encoder.rising == (ranks is RANKS)
        tokens = [encoder.bytes[x] for x in encoder.parts]
        short = [t for t in tokens if len(t) < 4]
        for _ in range(4000):
            a, b = r.choice(r.choice((tokens, short))), r.choice(r.choice((tokens, short)))
            assert encoder._agrees(ranks[a], ranks[b]) == (bpe.merged(ranks, a + b) == [a, b]), (a, b)
        for _ in range(500):
            piece = b"".join(r.choices(short, k=6))
            assert encoder.encode(piece) == ([ranks[piece]] if piece in ranks else [ranks[x] for x in bpe.merged(ranks, piece)])


def test_columns_are_encoded_without_merging(monkeypatch):
    """Once loaded, no pair of tokens is merged anew, and a unit is encoded once in a column."""
    import pyarrow as pa

    texts = [*ODD, *random_texts(200), None, *["some newword, newword. ***"] * 50]
    encoder, asked = bpe.RankEncoder(PATH, P.PATTERN), []
    monkeypatch.setattr(bpe, "merged", None)
    packed = encoder._packed
    encoder._packed = lambda units: [asked.extend(units), packed(units)][1]
    ends, ids = encoder.encode_all(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [OWN.encode_ordinary(x or "") for x in texts]
    assert len(asked) == len(set(asked))


def test_both_steps_share_a_worker(spark, make_docs):
    """The query's tasks need one Python worker each, and its rows are those of the two steps one after the other."""
    plan = queries.op5_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    docs = make_docs(list(enumerate(ODD + random_texts(50))) + [(900, None), (901, "twice"), (901, "twice"), (None, "x")])
    one = bpe.encode_and_decode(docs, PATH, P.PATTERN)
    two = bpe.decode_documents(bpe.encode_documents(docs, PATH, P.PATTERN), PATH)
    assert one.schema == two.schema
    assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str)
    assert bpe.encode_and_decode(make_docs([]), PATH, P.PATTERN).count() == 0
