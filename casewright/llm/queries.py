"""The opN_<name> queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_tools, exact_search, line_dedup, middle, order_minhash, packing, quality, simhash, source_audit, token_orc, toxicity, warc
from .common import scratch_path, table


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: its class (the component's first line) and whether it is kept."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).drop("key")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.document_spans(token_orc.read_token_orc(spark, path))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.arc_to_warc(warc.write_arc_rows(table(spark, sf_dir, "pages"))), path)
    read = warc.read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return read.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").alias("refers_to"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("lang", "class_distance", "word_distance")


def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_MORE = {"after": ("string", False), "also": ("string", False)}
#: Tools of the conversations that op9's query makes from `conversations`.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True), **_MORE},
    "lookup": {"query": ("string", True), "limit": ("integer", False), **_MORE},
    "count": {"query": ("string", True), "exact": ("boolean", True), "limit": ("integer", False), **_MORE},
}
#: So many conversations make one run of an agent.
RUN = 256


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Runs of tool calls: a user's turn calls a tool with its whole text, the assistant's turn after it is the result.

    A run is RUN conversations one after another. A call needs the one before it in its conversation, and the first of
    a conversation needs the first of the conversation before, so that chains are as long as a run; the first of a run
    needs the call after it. Every fifth conversation's second call needs two calls, every sixteenth's second and third
    need each other. Some later turns call nothing, so that their results have no call and references to them are
    unknown; some results are given for the next call, before it stands. Every fifth call has a limit of the wrong
    type, every seventh no query.
    """
    first = conversations.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first"))
    before = first.select((F.col("conv_id") + 1).alias("conv_id"), F.col("first").alias("before")).where(F.col("conv_id") % RUN != 0)
    rows = conversations.join(first, "conv_id", "left").join(before, "conv_id", "left")
    conv, turn, first, before = (F.col(c) for c in ("conv_id", "turn", "first", "before"))
    identifier = lambda c, t: F.concat(F.lit("c"), c.cast("string"), F.lit("-"), t.cast("string"))
    reference = lambda c, t: F.concat(F.lit("$"), identifier(c, t))
    begins, second = (turn == first) & (conv % RUN == 0), turn == first + 2
    after = F.when(begins | (second & (conv % 16 == 9)), reference(conv, turn + 2)).when(turn == first, reference(conv - 1, before))
    after = after.when(~(second & (conv % RUN == 0)), reference(conv, turn - 2))
    also = F.when(second & (conv % 5 == 2), reference(conv - 1, before))
    pick = (turn + conv) % 3
    name = F.when(pick == 0, "search").when(pick == 1, "lookup").otherwise("count")
    limit = F.when((turn + conv) % 5 == 0, F.parse_json(F.concat(F.lit('"'), turn.cast("string"), F.lit('"')))).otherwise(F.parse_json(turn.cast("string")))
    query = F.when((turn + conv) % 7 != 0, F.col("text"))
    exact = F.when(name == "count", F.lit(True))
    arguments = F.to_json(F.struct(after.alias("after"), also.alias("also"), exact.alias("exact"), limit.alias("limit"), query.alias("query")))
    calls = F.to_json(F.array(F.struct(identifier(conv, turn).alias("id"), name.alias("name"), arguments.alias("arguments"))))
    called = (F.col("role") == "user") & ~((turn > first) & ((conv + turn) % 13 == 5))
    answered = F.when((conv + turn) % 17 == 3, turn + 1).otherwise(turn - 1)
    return rows.select(
        F.expr(f"conv_id div {RUN}").alias("conv_id"),
        (conv * 1_000_000 + turn).alias("turn"),
        F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"),
        F.when(called, calls).alias("tool_calls"),
        F.when(F.col("role") == "assistant", identifier(conv, answered)).alias("tool_call_id"),
    )


def op9_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_tools.link_tool_calls(tool_messages(table(spark, sf_dir, "conversations")), TOOLS)
    return found.select("conv_id", "call_id", "turn", "name", F.col("level").cast("long").alias("level"), "status", F.array_join("errors", ";").alias("errors"), F.md5("json").alias("json_md5"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.order_fingerprints(table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.restored(middle.fill_in_middle(table(spark, sf_dir, "documents")), to="restored")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES = {f.__name__: f for f in (op1_hierarchical_packing, op2_fuzzy_lines, op3_token_orc, op4_arc_to_warc, op5_byte_bpe, op6_toxicity_grammar, op7_distribution_divergence, op8_simhash_ball, op9_tool_links, op10_order_minhash, op11_exact_top_k, op12_source_divergence, op13_fill_in_middle)}
#: DuckDB's sha256 gives lower-case hex of the UTF-8 bytes.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM f"""

_TEXT = """'"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"'"""
OP9_SQL = f"""
WITH RECURSIVE f AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY 1),
c AS (SELECT t.*, f.first, p.first AS before, 'c' || t.conv_id || '-' || t.turn AS id, t.conv_id // {RUN} AS run, t.conv_id * 1000000 + t.turn AS place, {_TEXT} AS quoted,
    CASE (t.turn + t.conv_id) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'count' END AS name, (t.turn + t.conv_id) % 5 = 0 AS bad, (t.turn + t.conv_id) % 7 = 0 AS none
  FROM conversations t LEFT JOIN f USING (conv_id) LEFT JOIN f p ON p.conv_id = t.conv_id - 1 AND t.conv_id % {RUN} <> 0),
s AS (SELECT *, CASE WHEN (turn = first AND conv_id % {RUN} = 0) OR (turn = first + 2 AND conv_id % 16 = 9) THEN 'c' || conv_id || '-' || (turn + 2)
      WHEN turn = first THEN 'c' || (conv_id - 1) || '-' || before WHEN NOT (turn = first + 2 AND conv_id % {RUN} = 0) THEN 'c' || conv_id || '-' || (turn - 2) END AS after,
    CASE WHEN turn = first + 2 AND conv_id % 5 = 2 THEN 'c' || (conv_id - 1) || '-' || before END AS also
  FROM c WHERE role = 'user' AND NOT (turn > first AND (conv_id + turn) % 13 = 5)),
r AS (SELECT DISTINCT * FROM (SELECT id, place, unnest([after, also]) AS needs FROM s) WHERE needs IS NOT NULL),
e AS (SELECT r.id, k.id AS needs, k.place < r.place AS back FROM r JOIN s k ON k.id = r.needs),
u AS (SELECT DISTINCT id FROM r WHERE needs NOT IN (SELECT id FROM s)),
moved AS (SELECT id FROM e WHERE NOT back UNION SELECT e.id FROM e JOIN moved m ON e.needs = m.id),
n AS (SELECT count(*) AS n FROM moved),
paths AS (SELECT id, 1 AS len FROM moved UNION SELECT e.id, len + 1 FROM paths p JOIN e ON e.needs = p.id, n WHERE len <= n),
l AS (SELECT id, CASE WHEN max(len) <= any_value(n) THEN max(len) END AS level FROM paths, n GROUP BY 1),
a AS (SELECT *, 'c' || conv_id || '-' || CASE WHEN (conv_id + turn) % 17 = 3 THEN turn + 1 ELSE turn - 1 END AS rid FROM c WHERE role = 'assistant'),
b AS (SELECT *, row_number() OVER (PARTITION BY run, rid ORDER BY place, text) AS nth FROM a),
j AS (SELECT coalesce(s.run, b.run) AS conv_id, coalesce(s.id, b.rid) AS call_id, coalesce(s.place, b.place) AS turn, s.name, s.turn AS t, s.quoted, s.after, s.also, s.bad, s.none, s.id, b.rid, b.place < s.place AS early, b.quoted AS result
  FROM s FULL JOIN b ON s.run = b.run AND s.id = b.rid AND b.nth = 1)
SELECT j.conv_id, call_id, j.turn, name, CASE WHEN t IS NOT NULL THEN CAST(CASE WHEN l.id IS NULL THEN 0 ELSE l.level END AS BIGINT) END AS level,
  CASE WHEN t IS NULL THEN 'orphan' WHEN l.id IS NOT NULL AND l.level IS NULL THEN 'cycle' WHEN rid IS NULL THEN 'unanswered' WHEN early THEN 'early' ELSE 'linked' END AS status,
  CASE WHEN t IS NOT NULL THEN array_to_string(list_filter([CASE WHEN bad THEN 'limit:not integer' END, CASE WHEN none THEN 'query:missing' END, CASE WHEN u.id IS NOT NULL THEN 'reference:unknown call' END], lambda x: x IS NOT NULL), ';') END AS errors,
  md5('{{"arguments":' || CASE WHEN t IS NULL THEN 'null' ELSE '{{' || CASE WHEN after IS NOT NULL THEN '"after":"$' || after || '",' ELSE '' END || CASE WHEN also IS NOT NULL THEN '"also":"$' || also || '",' ELSE '' END || CASE WHEN name = 'count' THEN '"exact":true,' ELSE '' END
    || '"limit":' || CASE WHEN bad THEN '"' || t || '"' ELSE CAST(t AS VARCHAR) END || CASE WHEN none THEN '' ELSE ',"query":' || quoted END || '}}' END
    || ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(result, 'null') || '}}') AS json_md5
FROM j LEFT JOIN l ON l.id = j.id LEFT JOIN u ON u.id = j.id"""

OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS one, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS two,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:one], '') AS a, array_to_string(units[one + 1:two], '') AS m, array_to_string(units[two + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""

ORACLES = {
    "op11_exact_top_k": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
    "op9_tool_links": OP9_SQL,
    "op4_arc_to_warc": OP4_SQL,
    "op7_distribution_divergence": quality.oracle_sql(),
}
