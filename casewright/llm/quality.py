"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histograms of character classes and of common words are held against those of its language, by
the Jensen-Shannon distance (base 2, so 0 to 1). References are sums over a language's documents: first over
all, then over those within TRIM_* of the first sums, so that junk doesn't shift what it is held against.
Guards on length leave a document alone where a histogram says too little about it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The ten commonest function words of English, German, French and Spanish.
COMMON_WORDS = ("the of and to in is that for as with", "der die und das den von zu mit ist ein", "de la le et les des en un du une", "el la que de y en los un las por")
WORDS = sorted({w for line in COMMON_WORDS for w in line.split()})
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CLASSES = ("space", "upper", "digit", "symbol", "mark", "other")

MIN_WORDS = 50
REPEATED_PERCENT = 50
#: Farther than this from its language's reference by either histogram, a document is rejected; or farther than BOTH by each.
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.50
BOTH = (0.15, 0.20)
#: Documents up to so many times their language's mean distances from the sums over all documents make the reference.
TRIM = 1.05
#: Guards: characters and words below which a histogram is not judged, and words below which a language has no reference.
MIN_CLASS_CHARS = 100
MIN_HISTOGRAM_WORDS = 100
MIN_REFERENCE_WORDS = 5000


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _spaced(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES[1:], text)


def _words(spaced: Column) -> Column:
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def base_metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, and the counts c of CLASSES and w of WORDS and all other words; with `carry` the whole row too.

    One pass over each text. Repeated windows are found by 64-bit hashes of three words, sorted with their
    places only where some hash repeats; each window covers the words that the one before it left.
    """
    carried = {"row": F.struct(*docs.columns)} if carry else {}
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c.alias(n) for n, c in carried.items()))
    d = d.withColumn("spaced", _spaced(F.col("text")))
    d = d.withColumn("words", _words(F.col("spaced"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n", F.size("words"))
    d = d.withColumn(
        "windows",
        F.when(F.col("n") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 2, F.lit(1))), lambda i: F.xxhash64(F.get("words", i - 1), F.get("words", i), F.get("words", i + 1)))),
    )
    d = d.withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    d = d.withColumn("placed", F.when(F.col("repeats"), F.sort_array(F.transform("windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    twice = F.filter("placed", lambda x, j: (F.get("placed", j - 1)["k"].eqNullSafe(x["k"])) | (F.get("placed", j + 1)["k"].eqNullSafe(x["k"])))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    plain = _words(F.replace(F.replace(F.lower("spaced"), F.lit(","), F.lit("")), F.lit("."), F.lit("")))
    d = d.withColumn("common", F.concat(F.lit("|"), F.array_join(F.filter(plain, lambda w: w.isin(WORDS)), "||"), F.lit("|")))
    chars, no_space = F.length("text"), F.length(F.replace("spaced", F.lit(" "), F.lit("")))
    d = d.select(
        "doc_id",
        "lang",
        *carried,
        F.col("n").cast("long").alias("n_words"),
        no_space.cast("long").alias("word_chars"),
        (chars - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        chars.cast("long").alias("chars"),
        F.regexp_count("text", F.lit("[A-ZÀ-ÖØ-Þ]")).alias("upper"),
        F.regexp_count("text", F.lit("[0-9]")).alias("digit"),
        F.regexp_count("text", F.lit("[.,;:!?'\"()-]")).alias("mark"),
        F.array(*(((F.length("common") - F.length(F.replace("common", F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("double") for w in WORDS)).alias("ws"),
    )
    other = F.greatest(F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("n_symbols"), F.lit(0))
    total = F.aggregate("ws", F.lit(0.0), lambda x, y: x + y)
    return d.select(
        *d.columns[: 8 + len(carried)],
        F.array(*(x.cast("double") for x in (F.col("chars") - F.col("word_chars"), F.col("upper"), F.col("digit"), F.col("n_symbols"), F.col("mark"), other))).alias("c"),
        F.array_append("ws", F.greatest(F.col("n_words") - total, F.lit(0.0))).alias("w"),
    )


def references(metrics: DataFrame) -> DataFrame:
    """r_lang, r_words, and the sums r_c and r_w of the counts of all documents of each language; a language has one row."""
    sums = lambda a, n: F.array(*(F.sum(F.get(a, F.lit(i))) for i in range(n)))
    return metrics.groupBy(F.col("lang").alias("r_lang")).agg(F.sum("n_words").alias("r_words"), sums("c", len(CLASSES)).alias("r_c"), sums("w", len(WORDS) + 1).alias("r_w"))


def js_distance(p: str, q: str, p_sum: str, q_sum: str) -> Column:
    """The Jensen-Shannon distance of two arrays of counts with their sums; null where either is empty."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def term(x, y):
        x, y = x / F.col(p_sum), y / F.col(q_sum)
        return part(x, (x + y) / 2) + part(y, (x + y) / 2)

    divergence = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((F.col(p_sum) > 0) & (F.col(q_sum) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _distances(metrics: DataFrame, refs: DataFrame) -> DataFrame:
    """The metrics with class_distance and word_distance, where the guards allow them.

    References have one row a language; adaptive execution broadcasts them only once their measured size is
    under the threshold, and splits the largest language's partition otherwise.
    """
    joined = metrics.join(refs, F.col("lang").eqNullSafe(F.col("r_lang")), "left")
    for x in ("c", "w", "r_c", "r_w"):
        joined = joined.withColumn(f"{x}_sum", F.aggregate(x, F.lit(0.0), lambda s, y: s + y))
    known = F.col("r_words") >= MIN_REFERENCE_WORDS
    classes = F.when(known & (F.col("chars") >= MIN_CLASS_CHARS), js_distance("c", "r_c", "c_sum", "r_c_sum"))
    words = F.when(known & (F.col("n_words") >= MIN_HISTOGRAM_WORDS), js_distance("w", "r_w", "w_sum", "r_w_sum"))
    return joined.select(*metrics.columns, classes.alias("class_distance"), words.alias("word_distance"))


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, carry: bool = False) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "quality")
    metrics = scratch.put(base_metrics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, carry=carry))
    narrow = metrics.drop("row")
    first = scratch.put(_distances(narrow, references(narrow)))
    means = first.groupBy(F.col("lang").alias("m_lang")).agg(F.avg("class_distance").alias("m_class"), F.avg("word_distance").alias("m_word"))
    near = (F.col("class_distance") <= TRIM * F.col("m_class")) & F.coalesce(F.col("word_distance") <= TRIM * F.col("m_word"), F.lit(True))
    refs = scratch.put(references(first.join(means, F.col("lang").eqNullSafe(F.col("m_lang"))).where(near)))
    scratch.drop(first)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    near = (by_class <= MAX_CLASS_DISTANCE) & (by_word <= MAX_WORD_DISTANCE) & ~((by_class > BOTH[0]) & (by_word > BOTH[1]))
    return _distances(metrics, refs).withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base metrics, base_failed, class_distance, word_distance, kept; one row for each row of `docs`.

    base_failed: under MIN_WORDS words, or over REPEATED_PERCENT of words in repeated windows. The method rejects
    a document whose class or word distance is over its bound, or both over BOTH; under the guards' lengths, or in a language (null
    is one of its own) with under MIN_REFERENCE_WORDS words, a distance is null and rejects nothing. A null text
    has no words. Repeated rows and ids are judged each on its own; other columns aren't read.
    """
    found = _judged(docs, id_col, text_col, lang_col)
    return found.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def keep_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that judge keeps, with all their columns; a row carries its verdict, so none is shuffled."""
    return _judged(docs, id_col, text_col, lang_col, carry=True).where("kept").select("row.*")


def _sql_js(p: str, q: str) -> str:
    m = "((z[1] / sp + z[2] / sq) / 2)"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    terms = f"list_sum(list_transform(list_zip({p}, {q}), lambda z: {part('(z[1] / sp)')} + {part('(z[2] / sq)')}))".replace("sp", f"list_sum({p})").replace("sq", f"list_sum({q})")
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest({terms} / 2, 0)) END"


def _sql_distances(refs: str) -> str:
    return f"""SELECT m.*, CASE WHEN r_words >= {MIN_REFERENCE_WORDS} AND chars >= {MIN_CLASS_CHARS} THEN {_sql_js("c", "r_c")} END AS class_distance,
      CASE WHEN r_words >= {MIN_REFERENCE_WORDS} AND n_words >= {MIN_HISTOGRAM_WORDS} THEN {_sql_js("w", "r_w")} END AS word_distance
      FROM m LEFT JOIN {refs} r ON m.lang IS NOT DISTINCT FROM r.r_lang"""


def _sql_references(of: str) -> str:
    sums = lambda a, n: ", ".join(f"CAST(sum({a}[{i + 1}]) AS DOUBLE)" for i in range(n))
    return f"SELECT lang AS r_lang, sum(n_words) AS r_words, [{sums('c', len(CLASSES))}] AS r_c, [{sums('w', len(WORDS) + 1)}] AS r_w FROM {of} GROUP BY lang"


def oracle_sql() -> str:
    """DuckDB SQL for the columns of op7's query; doc_id has to be unique."""
    words = ", ".join(f"len(list_filter(plain, lambda x: x = '{w}'))" for w in WORDS)
    either = ", ".join(f"'{w}'" for w in WORDS)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[,.]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS plain,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(CASE WHEN b IS NULL THEN 3 ELSE least(3, i - b) END) AS n FROM p GROUP BY doc_id),
base AS (SELECT d.*, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) AS chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
           length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digit,
           length(text) - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')) AS mark, [{words}] AS ws, len(list_filter(plain, lambda x: x IN ({either}))) AS wn
         FROM d LEFT JOIN r USING (doc_id)),
m AS (SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars,
        [CAST(chars - word_chars AS DOUBLE), upper, digit, n_symbols, mark, greatest(word_chars - upper - digit - mark - n_symbols, 0)] AS c,
        list_append(list_transform(ws, lambda x: CAST(x AS DOUBLE)), greatest(n_words - wn, 0)) AS w FROM base),
r1 AS ({_sql_references("m")}), f1 AS ({_sql_distances("r1")}),
typical AS (SELECT * FROM (SELECT *, avg(class_distance) OVER (PARTITION BY lang) AS mc, avg(word_distance) OVER (PARTITION BY lang) AS mw FROM f1)
  WHERE class_distance <= {TRIM} * mc AND coalesce(word_distance <= {TRIM} * mw, true)),
r2 AS ({_sql_references("typical")}), f2 AS ({_sql_distances("r2")}),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AS base_failed, coalesce(class_distance, 0) AS x, coalesce(word_distance, 0) AS y FROM f2)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  (NOT base_failed AND x <= {MAX_CLASS_DISTANCE} AND y <= {MAX_WORD_DISTANCE} AND NOT (x > {BOTH[0]} AND y > {BOTH[1]})) AS kept
FROM v"""
