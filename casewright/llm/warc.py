"""Legacy archives (ARC versions 1 and 2) to WARC 1.1, and reading WARC back.

ARC files are rows (path, content), as Spark's binaryFile source gives them; each is parsed as a stream by its
version's header lines and declared lengths. What WARC wants and ARC lacks is made from what is there: record
identifiers from the place and name of a record, ISO timestamps from 14-digit ones, types from the URL and the
block, digests from the payload. Payloads seen before become revisits of the first record that has them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_sieve, sieve

#: The fields of record header lines in either version.
FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length")}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this many bytes are always stored.
MIN_REVISIT_BYTES = 100
_CHUNK = 1 << 20
_GZIP = b"\x1f\x8b"


def _schema(fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in map(str.split, fields.split(","))])


class _Stream:
    """Bytes of a file, inflated piece by piece (gzip, in any number of members) where it is compressed.

    A cursor walks over the buffer; what lies before it is dropped only when more bytes are read, so the work is
    linear in the bytes whatever the records' sizes.
    """

    def __init__(self, content: bytes):
        self.raw, self.at, self.offset = content, 0, 0
        self.buffer, self.cursor = b"", 0
        self.inflate = zlib.decompressobj(31) if content[:2] == _GZIP else None

    def _next(self) -> bytes:
        """The next piece of the file's bytes; empty at the end."""
        if self.inflate is None:
            part = self.raw[self.at : self.at + _CHUNK]
            self.at += len(part)
            return part
        while True:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                self.at -= len(rest)
                if self.raw[self.at : self.at + 2] != _GZIP:
                    return b""
                self.inflate = zlib.decompressobj(31)
            part = self.inflate.unconsumed_tail
            if not part:
                part = self.raw[self.at : self.at + _CHUNK]
                self.at += len(part)
                if not part:
                    return b""
            if got := self.inflate.decompress(part, 4 * _CHUNK):
                return got

    def line(self) -> bytes:
        """The next line with its end; the rest where there is none; empty at the end."""
        parts = []
        while (end := self.buffer.find(b"\n", self.cursor)) < 0:
            parts.append(self.buffer[self.cursor :])
            self.buffer, self.cursor = self._next(), 0
            if not self.buffer:
                break
        parts.append(self.buffer[self.cursor : end + 1])
        self.cursor = end + 1
        out = b"".join(parts)
        self.offset += len(out)
        return out

    def take(self, n: int) -> bytes:
        parts = [self.buffer[self.cursor : self.cursor + n]]
        have = len(parts[0])
        self.cursor += have
        while have < n:
            self.buffer = self._next()
            if not self.buffer:
                self.cursor = 0
                break
            parts.append(self.buffer[: n - have])
            self.cursor = len(parts[-1])
            have += self.cursor
        self.offset += have
        return parts[0] if len(parts) == 1 else b"".join(parts)


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of an ARC file: the fields of their header lines, version, offset, block, truncated.

    The version block, which is first, says how later header lines read; without one, version 1 is assumed.
    Lines that are no header of that version are skipped until one is. A block shorter than declared is truncated.
    """
    stream, version = _Stream(content), 1
    while True:
        offset, line = stream.offset, stream.line()
        if not line:
            return
        words = line.rstrip(b"\r\n").decode("latin-1").split(" ")
        if words[0].startswith("filedesc:") and len(words) in (5, 10):
            fields = FIELDS[1 if len(words) == 5 else 2]
        else:
            fields = FIELDS[version]
        if len(words) < len(fields) or not words[-1].isdigit() or ":" not in words[0]:
            continue
        # A blank within the content type is the only one that some crawlers let through.
        extra = len(words) - len(fields)
        if extra:
            words[3 : 4 + extra] = [" ".join(words[3 : 4 + extra])]
        record = dict(zip(fields, words))
        length = int(record["length"])
        block = stream.take(length)
        if words[0].startswith("filedesc:"):
            version = 2 if block[:1] == b"2" else 1
        record |= {"version": version, "offset": offset, "block": block, "truncated": len(block) < length}
        yield record


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers with the blank line after them, and the payload; all is payload without them."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def http_header(head: bytes, name: str) -> str | None:
    m = re.search(rb"^" + re.escape(name.encode()) + rb":[ \t]*(.*?)[ \t]*\r?$", head, re.M | re.I)
    return m[1].decode("latin-1") if m else None


_ARC_SCHEMA = _schema("path string, offset bigint, version int, url string, ip string, date string, mime string, truncated boolean, key bigint, payload_bytes bigint, payload_digest string, head binary, payload binary")


def read_arc(files: DataFrame, key_header: str = "X-Record-Key") -> DataFrame:
    """One row per record of ARC files (path, content); a file without records has none.

    key is the whole number of 64 bits in the HTTP header of that name, or null.
    """

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(_ARC_SCHEMA)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, content, rows, size = path.as_py(), content.as_py() or b"", [], 0
                for r in arc_records(content):
                    head, payload = http_parts(r["block"]) if r["url"].startswith("http") else (b"", r["block"])
                    key = http_header(head, key_header)
                    key = int(key) if key and re.fullmatch(r"-?\d{1,19}", key) and -(1 << 63) <= int(key) < 1 << 63 else None
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((path, r["offset"], r["version"], r["url"], r["ip"], r["date"], r["mime"], r["truncated"], key, len(payload), digest, head, payload))
                    size += len(r["block"])
                    if size >= 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, _ARC_SCHEMA)


def warc_fields(records: DataFrame) -> DataFrame:
    """Adds record_id (a UUID urn of path, offset, URL and date), warc_date and record_type to rows of read_arc.

    Dates of 8 to 14 digits are filled up with zeros; others become 1970. filedesc records are warcinfo, those
    with an HTTP head response, others resource.
    """
    h = F.md5(F.concat_ws("\x01", "path", "offset", "url", "date"))
    uuid = F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    d = F.when(F.col("date").rlike(r"^\d{8,14}$"), F.rpad("date", 14, "0")).otherwise(F.lit("19700101000000"))
    date = F.regexp_replace(d, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    kind = F.when(F.col("url").startswith("filedesc:"), "warcinfo").when(F.col("url").startswith("http"), "response").otherwise("resource")
    return records.withColumns({"record_id": uuid, "warc_date": date, "record_type": kind})


def _rank() -> list:
    return [F.col("key").isNull().alias("none"), F.col("key").alias("k"), F.col("date").alias("d"), F.col("path").alias("p"), F.col("offset").alias("o")]


def arc_to_warc(files: DataFrame, key_header: str = "X-Record-Key", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows of read_arc with WARC fields, in which repeated payloads of at least `min_revisit_bytes` are revisits.

    Of equal payloads the record with the smallest key is kept, then the earliest, then the first by path and
    offset; the others refer to it (refers_id, refers_url, refers_date, refers_key) and lose their payload. Records
    are parsed once; only those that may be repeated are shuffled with their payloads.
    """
    records = Scratch(files.sparkSession, "warc").put(warc_fields(read_arc(files, key_header)))
    repeatable = (F.col("record_type") == "response") & (F.col("payload_bytes") >= min_revisit_bytes)
    first = F.min(F.struct(*_rank(), F.col("record_id").alias("id"), F.col("url").alias("u"), F.col("warc_date").alias("w"), F.col("key").alias("key"))).alias("first")
    firsts = records.where(repeatable).groupBy("payload_digest").agg(first, F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("payload_digest").alias("digest"), "first")
    firsts = Scratch(files.sparkSession, "warc").put(firsts)
    slots = sieve(firsts.select(F.xxhash64("digest").alias("k")), "k")
    sifted = in_sieve(records, F.when(repeatable, F.xxhash64("payload_digest")), slots, "hit")
    told = {"refers_id": "id", "refers_url": "u", "refers_date": "w", "refers_key": "key"}
    kinds = {f.name: f.dataType for f in firsts.schema["first"].dataType}
    alone = sifted.where(~F.col("hit")).withColumns({n: F.lit(None).cast(kinds[c]) for n, c in told.items()})
    joined = sifted.where("hit").join(firsts, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.coalesce(F.col("first.id") != F.col("record_id"), F.lit(False))
    found = joined.withColumns({n: F.when(revisit, F.col(f"first.{c}")) for n, c in told.items()} | {"record_type": F.when(revisit, "revisit").otherwise(F.col("record_type")), "payload": F.when(~revisit, F.col("payload"))})
    return alone.drop("hit").unionByName(found.drop("hit", "digest", "first"))


def write_warc(records: DataFrame, path: str, records_per_file: int = 5000) -> None:
    """Writes rows of arc_to_warc as gzipped WARC files of at most `records_per_file` records.

    A record ends with two line ends, so the last newline is the text writer's own. Bytes that aren't UTF-8
    pass through unchanged. Files stay small enough to be read whole by one task each.
    """
    block = F.concat(F.coalesce("head", F.lit(b"")), F.coalesce("payload", F.lit(b"")))

    def field(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")

    col = F.col
    http = col("record_type").isin("response", "revisit")
    mime = F.when(col("record_type") == "warcinfo", "application/warc-fields").when(http & (F.length("head") > 0), "application/http; msgtype=response").otherwise(F.regexp_replace("mime", r"[\r\n]", " "))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", col("record_type")),
        field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        field("WARC-Date", col("warc_date")),
        field("WARC-Target-URI", F.when(col("record_type") != "warcinfo", col("url"))),
        field("WARC-IP-Address", F.when((col("record_type") != "warcinfo") & (col("ip") != "0.0.0.0"), col("ip"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        field("WARC-Truncated", F.when(col("truncated"), F.lit("unspecified"))),
        field("WARC-Profile", F.when(col("record_type") == "revisit", F.lit(REVISIT_PROFILE))),
        field("WARC-Refers-To", F.concat(F.lit("<"), "refers_id", F.lit(">"))),
        field("WARC-Refers-To-Target-URI", col("refers_url")),
        field("WARC-Refers-To-Date", col("refers_date")),
        field("X-Record-Key", col("key")),
        field("X-Refers-To-Key", col("refers_key")),
        field("X-Payload-Length", col("payload_bytes")),
        field("Content-Type", mime),
        field("Content-Length", F.length("block")),
        F.lit("\r\n"),
    )
    value = F.concat(header.cast("binary"), col("block"), F.lit(b"\r\n\r")).cast("string")
    records.withColumn("block", block).select(value.alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_WARC_SCHEMA = _schema("path string, record_id string, record_type string, url string, warc_date string, key bigint, payload_bytes bigint, payload_digest string, refers_id string, refers_key bigint")


def warc_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of each record, by declared lengths."""
    stream = _Stream(content)
    while line := stream.line():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.line().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        yield headers, stream.take(int(headers.get("content-length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under `path`; figures of stored payloads are taken from their bytes, those of revisits from the headers."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(_WARC_SCHEMA)
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for h, block in warc_records(content.as_py() or b""):
                    kind = h.get("warc-type")
                    size, digest = number(h.get("x-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind != "revisit":
                        payload = http_parts(block)[1] if h.get("content-type", "").startswith("application/http") else block
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    rows.append((name.as_py(), h.get("warc-record-id", "").strip("<>"), kind, h.get("warc-target-uri"), h.get("warc-date"), number(h.get("x-record-key")), size, digest, h.get("warc-refers-to", "").strip("<>") or None, number(h.get("x-refers-to-key"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, _WARC_SCHEMA)


def write_arc_rows(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = 4 << 20) -> DataFrame:
    """(path, content): a legacy archive of `pages`, to convert; file after file in version 1 and 2.

    Each page is an HTTP response whose X-Record-Key is its id (none for a null id); a null html is empty. White
    space and control characters in a URL are escaped, and one without a scheme gets http.
    """

    def run(batches):
        from datetime import datetime, timedelta
        from urllib.parse import quote

        import pyarrow as pa
        from pyspark import TaskContext

        task, files, records, size = TaskContext.get().partitionId(), 0, [], 0

        def out():
            version = 1 + files % 2
            name = f"pages-{task:05d}-{files:05d}.arc"
            about = f"{version} 0 casewright\n{'URL IP-address Archive-date Content-type Archive-length' if version == 1 else 'URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length'}\n".encode()
            body, middle = [], "" if version == 1 else f"200 - - 0 {name} "
            body.append(f"filedesc://{name} 0.0.0.0 20000101000000 text/plain {middle}{len(about)}\n".encode() + about + b"\n")
            for url, date, block in records:
                body.append(f"{url} 192.0.2.1 {date} text/html {middle}{len(block)}\n".encode() + block + b"\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(body)], pa.binary())], names=["path", "content"])

        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                url = quote(url or "unknown.invalid/", safe="!#$%&'()*+,/:;=?@[]~")
                url = url if url.startswith(("http://", "https://")) else f"http://{url}"
                date = (datetime(2000, 1, 1) + timedelta(seconds=(key or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                mark = "" if key is None else f"X-Record-Key: {key}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                records.append((url, date, block))
                size += len(block)
                if size >= file_bytes:
                    yield out()
                    files, records, size = files + 1, [], 0
        if records:
            yield out()

    return pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "path string, content binary")
