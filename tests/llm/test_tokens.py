import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from casewright.llm import packing, token_orc
from casewright.llm.tokens import FileEncoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a", " a", "a ", "Hello  world\n\nIt's <|endoftext|> 12 345\t\tx", "a\x1cb \x1d c", "é è　日本語 テスト\n \nŹ ΑΣ ΟΔΟΣ. İI", "x\ny", "x \ny", "x\n y", "!\x1c\x1c?", "don't can't 'll 's'd", "﻿zero​width", "🙂 🙂🙂 ok", "a" * 5000, "word. " * 400, "tail\n", "\r\nq\r\n\r\nr", "Ünï cödé\xa0nbsp", "hello <|endoftext|> x", "<|EndOfText|>", "a<|startoftext|>b <|endoftext|>\n", "< | a <| b"]


@cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def whole(path, text):
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def random_texts(n):
    r = random.Random(3)
    return ["".join(r.choice(["a", "the", " ", " ", "\n", ".", "'s", "é", "\t", "9", "日", "́", "Q"]) for _ in range(r.randrange(80))) for _ in range(n)]


def test_units_give_the_ids_of_whole_texts():
    for path, spaces in ((BYTE, True), (WORD, False)):
        enc = FileEncoder(path, spaces, memo_limit=50)
        for text in ODD + random_texts(400):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == whole(path, text), repr(text)
        assert enc.encode(None) == b""


ROWS = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (101, "many words here " * 3000), (700, "twice"), (700, "twice"), (None, "no id")]


def test_packing_places_each_id_once(spark, make_docs):
    got = packing.pack_documents(make_docs(ROWS), BYTE, buffer_tokens=4096).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, text in ROWS:
        if k in (700, None):
            continue
        ids = whole(BYTE, text or "") + [1]
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == ids
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    assert sum(r.length for r in by_doc[700]) == 2 * (len(whole(BYTE, "twice")) + 1)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        total = 0
        for r in rows:
            assert r.offset == total
            total += r.length
        assert total <= 2048 and total & (total - 1) == 0 and {r.tier for r in rows} == {total}
    steps = {}
    for r in got:
        steps[r.step_group] = steps.get(r.step_group, 0) + r.length
    parts = {}
    for step, tokens in steps.items():
        parts.setdefault(step >> 40, {})[step] = tokens
    for groups in parts.values():
        assert all(tokens == 1 << 15 for step, tokens in groups.items() if step != max(groups))


def test_packing_of_an_empty_table(spark, make_docs):
    assert packing.pack_documents(make_docs([]), BYTE).count() == 0


def test_step_groups_hold_equal_tokens_over_all_tiers():
    packer, r = packing.TierPacker(step_tokens=4096), random.Random(5)
    sizes, cost = {}, {}
    rows, total = [], 0
    for k in range(900):
        n = r.choice([r.randrange(1, 300), r.randrange(1, 1500)])
        total += n
        packer.add(k, b"\0\0\0\0" * n)
        if k % 100 == 99:
            packer.pack(last=False)
            rows += packer.rows(last=False)
    packer.pack(last=True)
    rows += packer.rows()
    for _, _, length, _, _, _, _, tier, step in rows:
        sizes[step] = sizes.get(step, 0) + length
        cost.setdefault((step, tier), []).append(length**2)
    assert sum(sizes.values()) == total and sorted(sizes) == list(range(len(sizes)))
    assert [sizes[k] for k in sorted(sizes)][:-1] == [4096] * (len(sizes) - 1) and 0 < sizes[len(sizes) - 1] <= 4096
    assert {tier for _, tier in cost} > {2048, 1024, 512, 256}


def test_packing_pads_no_more_than_a_plain_packer():
    """Best fit of whole documents into windows of 2048 leaves gaps; these windows have none."""
    packer, r, bins, docs = packing.TierPacker(), random.Random(9), [], []
    for k in range(500):
        docs.append(r.randrange(1, 2000))
        packer.add(k, b"\0\0\0\0" * docs[-1])
    for n in sorted(docs, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            best = min(fits, key=bins.__getitem__)
            bins[best] -= n
        else:
            bins.append(2048 - n)
    packer.pack(last=True)
    windows = {}
    for _, _, length, _, _, seq, _, tier, _ in packer.rows():
        windows.setdefault(seq, [tier, 0])[1] += length
    assert sum(bins) > 0 == sum(tier - used for tier, used in windows.values())


def test_orc_round_trip(spark, make_docs, tmp_path):
    path = str(tmp_path / "orc")
    token_orc.write_token_orc(make_docs(ROWS), path, WORD, partitions=3)
    tokens = token_orc.read_token_orc(spark, path)
    got = sorted(token_orc.document_spans(tokens).collect(), key=lambda r: r.start)
    want = sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    start = 0
    for r, (k, text) in zip(got, want):
        if k != 700 and k is not None:
            ids = whole(WORD, text or "") + [1]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.start == start
        start += r.n_tokens
    some = token_orc.read_token_orc(spark, path, [2, 101])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert {r.doc_id for r in some.collect()} == {2, 101}


def test_orc_of_an_empty_table(spark, make_docs, tmp_path):
    path = str(tmp_path / "orc")
    token_orc.write_token_orc(make_docs([]), path, WORD)
    assert token_orc.document_spans(token_orc.read_token_orc(spark, path)).count() == 0


def test_orc_files_hold_indexes_run_lengths_and_bloom_filters(spark, tmp_path):
    """A reader that asks for an absent id reads no rows of the stripes; run-length encoding makes repeated ids small."""
    import glob
    import os

    from pyarrow import orc

    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "'the same words again' as text")
    path, plain = str(tmp_path / "orc"), str(tmp_path / "plain")
    token_orc.write_token_orc(docs, path, WORD, partitions=2)
    token_orc.read_token_orc(spark, path).write.option("orc.bloom.filter.columns", "").option("orc.create.index", "false").orc(plain)
    files = sorted(glob.glob(f"{path}/*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 20_000
    size = lambda d: sum(os.path.getsize(f) for f in glob.glob(f"{d}/*.orc"))
    assert size(path) > size(plain)  # the indexes and filters
    assert size(path) < 20_000 * 5 * 4  # far less than the ids' own bytes, filters and all
    read = token_orc.read_token_orc(spark, path, [10_001])
    assert read.count() == 0
    groups = {n: m for n, m in ((f, orc.ORCFile(f)) for f in files)}
    assert all(m.row_index_stride == 1000 and m.nstripes >= 1 and m.compression == "ZSTD" for m in groups.values())


def test_words_with_marks_are_encoded_in_parts(tmp_path):
    """Words whose stems, or marks, are new, known, or encoded whole give the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from casewright.llm.tokens import FileEncoder

    texts = ["stem stem, stem*** new***", "new stem$$$ é, é *** , 12, 12", "a,b a,b. New, new,\nNew stem***", "word-- word *** (x) x)"]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        encoder, whole = FileEncoder(path, keeps), Tokenizer.from_file(path)
        for text in texts * 2:
            ids = whole.encode(text, add_special_tokens=False).ids
            assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_columns_give_the_ids_of_each_text():
    """Whatever stands in a column, and however it is cut, each text has its own ids; plain texts' units are encoded in one go."""
    import pyarrow as pa

    texts = [None, "", *ODD, *random_texts(300), None, "x" * 9, ""]
    for path, spaces in ((BYTE, True), (WORD, False)):
        enc = FileEncoder(path, spaces, memo_limit=50)
        for column in (pa.array(texts), pa.array(texts).slice(3, 40), pa.array(texts, pa.large_string()), pa.array([None, ""]), pa.array([], pa.string())):
            ends, ids = enc.encode_all(column)
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [whole(path, x or "") for x in column.to_pylist()]
        asked, packed = [], enc._packed
        enc._packed = lambda units: [asked.extend(units), packed(units)][1]
        enc.encode_all(pa.array([f"new word{chr(97 + k)}, and words\nof a text." for k in range(20)] * 3))
        assert len(asked) == len(set(asked)) <= 20 + 7
