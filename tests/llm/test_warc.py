import gzip
import hashlib

from casewright.llm import warc

V1 = b"filedesc://a.arc 0.0.0.0 19990101000000 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n" + b"\n" * 12
HTTP = b"HTTP/1.0 200 OK\r\nX-Record-Key: 7\r\n\r\n"


def arc(version, *records):
    about = b"1 0 Org\nURL ...\n" if version == 1 else b"2 0 Org\nURL ...\n"
    middle = b"" if version == 1 else b"200 - - 0 x.arc "
    out = b"filedesc://x.arc 0.0.0.0 19990101000000 text/plain " + middle + str(len(about)).encode() + b"\n" + about + b"\n"
    for url, date, mime, block in records:
        out += b" ".join([url, b"192.0.2.9", date, mime, *([middle.strip()] if middle else []), str(len(block)).encode()]) + b"\n" + block + b"\n"
    return out


def test_header_lines_of_both_versions_and_lengths():
    block = HTTP + b"http://fake.example/ 1.2.3.4 19990101000000 text/html 5\nhello"  # a header line inside a payload
    for version in (1, 2):
        data = arc(version, (b"http://a/", b"20010203040506", b"text/html; charset=x", block), (b"dns:a", b"20010203", b"text/dns", b"a record"), (b"http://b/", b"x", b"image/png", b"\x00\xff\n\n"))
        for content in (data, gzip.compress(data), gzip.compress(data[:90]) + gzip.compress(data[90:])):
            got = list(warc.arc_records(content))
            assert [r["url"] for r in got] == ["filedesc://x.arc", "http://a/", "dns:a", "http://b/"]
            assert [r["version"] for r in got] == [version] * 4 and got[1]["block"] == block and got[3]["block"] == b"\x00\xff\n\n"
            assert got[1]["mime"] == "text/html; charset=x" and not any(r["truncated"] for r in got)
    cut = list(warc.arc_records(data[:-4]))
    assert cut[-1]["truncated"]
    junk = list(warc.arc_records(b"not a header\n\n" + data))
    assert [r["url"] for r in junk] == [r["url"] for r in got]
    assert list(warc.arc_records(b"")) == []


def test_conversion_keeps_bytes_and_marks_revisits(spark, tmp_path):
    same = bytes(range(256)) * 2
    one = arc(1, (b"http://a/", b"20010203040506", b"image/png", HTTP.replace(b"7", b"9") + same), (b"http://b/", b"20010203040507", b"image/png", HTTP + same), (b"dns:a", b"bad", b"text/dns", b"a record"))
    two = arc(2, (b"http://c/", b"20010203", b"text/html", HTTP.replace(b"X-Record-Key: 7\r\n", b"") + same), (b"http://d/", b"20010203", b"text/html", HTTP.replace(b"7", b"1") + b"short"), (b"http://e/", b"20010203", b"text/html", HTTP.replace(b"7", b"2") + b"short"))
    files = spark.createDataFrame([("one.arc", one), ("two.arc.gz", gzip.compress(two)), ("none", b""), ("null", None)], "path string, content binary")
    path = str(tmp_path / "warc")
    warc.write_warc(warc.arc_to_warc(files), path, records_per_file=2)
    got = {r.url or "info": r for r in warc.read_warc(spark, path).collect()}
    digest = hashlib.sha256(same).hexdigest()
    assert {u: r.record_type for u, r in got.items()} == {"info": "warcinfo", "http://a/": "revisit", "http://b/": "response", "dns:a": "resource", "http://c/": "revisit", "http://d/": "response", "http://e/": "response"}
    for u in ("http://a/", "http://b/", "http://c/"):
        assert (got[u].payload_bytes, got[u].payload_digest) == (512, digest)
    assert got["http://a/"].refers_key == got["http://c/"].refers_key == 7 and got["http://a/"].refers_id == got["http://b/"].record_id
    assert got["http://c/"].warc_date == "2001-02-03T00:00:00Z" and got["dns:a"].warc_date.startswith("1970") and got["http://c/"].key is None
    for f in (tmp_path / "warc").glob("*.gz"):
        for headers, block in warc.warc_records(f.read_bytes()):
            assert headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            assert headers["warc-record-id"].startswith("<urn:uuid:")


def test_pages_round_trip(spark, tmp_path):
    long, rows = "long é page " * 20_000, []
    texts = [None, "", "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, long, long, "WARC/1.1\r\n\r\n" * 20, "a\r\n\r\nb\n"]
    rows = [(k, f"http://h/{k} q\n", t, "extra") for k, t in reversed(list(enumerate(texts)))] + [(None, None, "z" * 100, "e"), (50, "", "z" * 100, "e"), (50, "ftp://x", "z" * 100, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string").repartition(3)
    path = str(tmp_path / "pages")
    warc.write_warc(warc.arc_to_warc(warc.write_arc_rows(df, file_bytes=3000)), path)
    got = [r for r in warc.read_warc(spark, path).collect() if r.record_type != "warcinfo"]
    assert len(got) == len(rows)
    first = {}
    for k, _, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(t or "", k)
    for r in got:
        if r.key is None or r.key == 50:
            assert r.record_type in ("response", "revisit") and r.refers_key in (None, 50)
            continue
        b = (texts[r.key] or "").encode()
        revisit = len(b) >= 100 and first[texts[r.key]] != r.key
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_key) == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[texts[r.key]] if revisit else None)
    assert sum(r.record_type == "response" for r in got if r.key in (None, 50)) == 1
    warc.write_warc(warc.arc_to_warc(warc.write_arc_rows(df.limit(0))), str(tmp_path / "none"))


def test_the_archive_is_parsed_once(spark, tmp_path, monkeypatch):
    """Names and offsets hang on how the pages are split: were they read twice, a first record might refer to itself and lose its payload."""
    from casewright.llm import queries

    rows = [(k, f"http://h/{k}", "y" * 200 if k % 2 else f"{k} " * 100) for k in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8).write.parquet(str(tmp_path / "pages.parquet"))
    inner, made = warc.write_arc_rows, spark.sparkContext.accumulator(0)

    def counted(pages):
        def count(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return inner(pages).mapInArrow(count, "path string, content binary")

    monkeypatch.setattr(warc, "write_arc_rows", counted)
    got = {r.page_id: r for r in queries.op4_arc_to_warc(spark, str(tmp_path)).collect()}
    files = inner(spark.read.parquet(str(tmp_path / "pages.parquet"))).count()
    assert made.value == files and len(got) == 40
    assert {k for k, r in got.items() if r.record_type == "response"} == {1, *range(0, 40, 2)}
    assert {r.refers_to for r in got.values() if r.record_type == "revisit"} == {1}


def test_parsing_time_is_linear_in_the_records():
    import time

    def took(n):
        data = gzip.compress(arc(1, *[(b"http://a/", b"20010203040506", b"text/html", HTTP + b"x" * 3000)] * n))
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            assert sum(1 for _ in warc.arc_records(data)) == n + 1
            best = min(best, time.process_time() - began)
        return best / n

    assert took(8000) < 2 * took(1000)


def test_records_across_pieces_of_the_buffer():
    blocks = [HTTP + bytes([65 + k % 26]) * size for k, size in enumerate((10, 3 << 20, 5, (1 << 20) - 700, 9 << 20, 0, 17))]
    data = arc(2, *((b"http://a/" + b"q" * 5000, b"20010203040506", b"text/html", x) for x in blocks))
    for content in (data, gzip.compress(data, 1), b"".join(gzip.compress(data[k : k + 70_001], 1) for k in range(0, len(data), 70_001))):
        got = list(warc.arc_records(content))
        assert [r["block"] for r in got[1:]] == blocks
        assert all(data[r["offset"] :].startswith(r["url"].encode()) for r in got)


def test_ids_of_the_whole_range(spark, tmp_path):
    text, most = "z" * 150, (1 << 63) - 1
    rows = [(most, "http://h/1", text), (-most - 1, "http://h/2", text), (most - 1, "http://h/3", "w" * 120), (None, "http://h/4", "w" * 120), (1 << 62, "http://h/5", "v" * 110), (None, "http://h/6", "v" * 110)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "range")
    warc.write_warc(warc.arc_to_warc(warc.write_arc_rows(df)), path)
    got = {r.key: (r.record_type, r.refers_key) for r in warc.read_warc(spark, path).collect() if r.record_type != "warcinfo" and r.key is not None}
    assert got == {most: ("revisit", -most - 1), -most - 1: ("response", None), most - 1: ("response", None), 1 << 62: ("response", None)}
