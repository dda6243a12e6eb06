"""Fill-in-the-middle: documents cut at two places between units, their parts put in another order.

A unit is a run of other than white space with the white space before it, or the white space that ends a text.
One Aho-Corasick automaton reads a text once and reports only white space and sentinels. The gaps between these
events say where units end, so the number of units is a count of gaps and the place of a unit's end a lookup among
them: nothing is kept for the characters between, and no unit is ever cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

#: What stands before each part of a document that was cut.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE = " \t\n\x0b\f\r"
#: Of 100 documents so many are cut, and so many of those have the suffix first.
CUT, SUFFIX_FIRST = 50, 80
SEED = 42


def event_automaton():
    """Reports white space as 0 and sentinels as 1."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for word in WHITE:
        found.add_word(word, 0)
    for word in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(word, 1)
    found.make_automaton()
    return found


def unit_ends(automaton, text: str):
    """(n, place, marked): how many units there are, place(k) where the first k of them end, whether a sentinel occurs."""
    import numpy as np

    events = np.fromiter(automaton.iter(text), dtype=[("at", "<i8"), ("kind", "<i8")])
    white = events["at"][events["kind"] == 0]
    # A unit ends where white space follows something else; the last one ends with the text, be it white space or not.
    ends = white[np.diff(white, prepend=-1) > 1]
    n = len(ends) + bool(text)
    return n, lambda k: 0 if k == 0 else len(text) if k == n else int(ends[k - 1]), len(white) < len(events)


def _draws(doc_id: Column) -> list[Column]:
    """Four whole numbers of 32 bits from the id: the first digits of a digest; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output; one row for each row.

    n: units of the whole text. form: plain (the output is the text, and there are no numbers of characters), psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle). Plain are empty and null texts, texts with a sentinel and
    all but `cut` in a hundred. Places and form hang on the id and n alone, so rows that repeat an id and a text have
    the same output. Other columns aren't read; an empty table gives no rows. No shuffle.
    """
    draws = _draws(F.col(id_col))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws, 1)))
    schema = T.StructType([*base.select("doc_id", "text").schema, T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType())])

    def run(batches):
        import pyarrow as pa

        automaton = event_automaton()
        for batch in batches:
            rows = []
            for text, *h in zip(batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
                n, place, marked = unit_ends(automaton, text := text.as_py())
                if not text or marked or h[2] % 100 >= cut:
                    rows.append((n, "plain", None, None))
                else:
                    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    rows.append((n, "spm" if h[3] % 100 < suffix_first else "psm", place(one), place(two)))
            found = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], names=schema.names)

    parts = base.mapInArrow(run, schema)
    whole = F.length("text")
    prefix, middle, suffix = F.substring(F.col("text"), F.lit(1), F.col("one")), F.substring(F.col("text"), F.col("one") + 1, F.col("two") - F.col("one")), F.substring(F.col("text"), F.col("two") + 1, whole)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return parts.select("doc_id", "n", "form", F.col("one").alias("prefix_chars"), (F.col("two") - F.col("one")).alias("middle_chars"), output.alias("output"))


def restored(rows: DataFrame, *, output_col: str = "output", form_col: str = "form", to: str = "text") -> DataFrame:
    """Adds the text that an output and its form were made from. A cut text holds no sentinel, and none arises where parts meet, so the first of each is the one put there."""
    (parts,) = unused(rows, "parts")
    first, second = (F.when(F.col(form_col) == "psm", F.lit(a)).otherwise(F.lit(b)) for a, b in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    body = F.substring(F.col(output_col), F.length(first) + 1, F.length(output_col))
    cut = F.split(body, F.concat(F.lit("<["), F.substring(second, 2, 1), F.lit("M]>")), 3)
    one, two, middle = (F.get(F.col(parts), k) for k in range(3))
    text = F.when(F.col(form_col) == "plain", F.col(output_col)).when(F.col(form_col) == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return rows.withColumn(parts, F.when(F.col(form_col) != "plain", cut)).withColumn(to, text).drop(parts)
