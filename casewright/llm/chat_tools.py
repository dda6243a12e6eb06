"""Tool-call linking in conversations, with DataFrame functions only.

Calls and results are joined by conversation and identifier (a shuffled hash join on both, so one long
conversation spreads by its identifiers). Calls whose arguments hold the result of another call ("$id") come
after it: the order of turns already puts every call behind the earlier ones it needs, however long such a chain
is. Only in conversations where a call needs a later one are calls placed by levels: chains of calls that need one
other each are followed by pointer doubling, so their length costs its logarithm in rounds, and calls that need
several are placed once the chains between them are short-cut. Arguments are validated against the tools' schemas and everything is serialised
as canonical JSON: no blanks, keys in order, by Spark's variant type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CALLS = "array<struct<id: string, name: string, arguments: string>>"
#: Types of arguments, and what Spark's variant calls values of them.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def _conversation() -> Column:
    """A key of conv_id that tells null from an empty text."""
    return F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("conv")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """nth: the place, from 1, among rows that share an identifier in their conversation."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "id").orderBy(*order)))


def extract_calls(messages: DataFrame) -> DataFrame:
    """conv, conv_id, id, nth, turn, place, name, arguments of the calls in tool_calls (a JSON array of id, name, arguments).

    JSON that isn't such an array gives none; calls that are equal in all of these are one.
    """
    parsed = messages.select(_conversation(), "conv_id", "turn", F.posexplode(F.from_json("tool_calls", CALLS)).alias("place", "call"))
    calls = parsed.where(F.col("call").isNotNull()).select("conv", "conv_id", F.col("call.id").alias("id"), "turn", "place", F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    return _numbered(calls.distinct(), "turn", "place", "name", "arguments")


def extract_results(messages: DataFrame) -> DataFrame:
    """conv, conv_id, id, nth, turn, content of messages of role `tool`; equal ones are one."""
    rows = messages.where(F.col("role") == "tool").select(_conversation(), "conv_id", F.col("tool_call_id").alias("id"), "turn", "content")
    return _numbered(rows.distinct(), "turn", "content")


def argument_errors(schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted texts of what is wrong with `args` (a variant) for the tool `name`; schemas: tool -> argument -> (kind, required)."""
    object_of = F.schema_of_variant("args").startswith("OBJECT")
    found = [F.when(F.col("args").isNull(), F.lit("arguments:not JSON")).when(~object_of, F.lit("arguments:not an object"))]
    found.append(F.when(F.col("name").isNull() | ~F.col("name").isin(list(schemas)), F.lit("name:unknown tool")))
    usable = F.col("args").isNotNull() & object_of
    for tool, fields in schemas.items():
        here = usable & (F.col("name") == tool)
        for field, (kind, required) in fields.items():
            value = F.variant_get("args", f"$.{field}", "variant")
            told = F.schema_of_variant(value)
            absent = value.isNull() | (told == "VOID")
            right = F.greatest(*(F.coalesce(told.startswith(k), F.lit(False)) for k in KINDS[kind]), F.lit(False))
            if required:
                found.append(F.when(here & absent, F.lit(f"{field}:missing")))
            found.append(F.when(here & ~absent & ~right, F.lit(f"{field}:not {kind}")))
    return F.sort_array(F.filter(F.array(*found), lambda e: e.isNotNull()))


def _after(k: str, c: str, m: str) -> tuple[Column, Column, Column]:
    """A reference's (k, c, m), from columns of these names, put after that of the call it needs (t_k, t_c, t_m).

    They say what level x of the call at the far end makes of the near one's: at least m, and x + k, where x is over
    0, else c.
    """
    return F.col(k) + F.col("t_k"), F.when(F.col("t_c") > 0, F.greatest(F.col("t_c") + F.col(k), m)).otherwise(F.col(c)), F.greatest(F.col("t_m") + F.col(k), m)


def _far(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"t_{c}") for c in rows.columns))


def _settled(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, level) of the calls whose references are all known (null: one of them is in or behind a cycle), and one row (node, needs, k, c, m) for each open one of the others.

    rows: node, needs (null where it is known, and c the level that it asks for), k, c, m, bad.
    """
    known = rows.groupBy("node").agg(F.count("needs").alias("n"), F.max(F.when(F.col("needs").isNull(), F.col("c"))).alias("g"), F.max("bad").alias("any_bad")).withColumnRenamed("node", "k_node")
    known = scratch.put(known)
    done = scratch.put(known.where("any_bad or n = 0").select(F.col("k_node").alias("node"), F.when(~F.col("any_bad"), F.col("g")).alias("level")))
    merged = rows.where("needs is not null").groupBy("node", "needs").agg(*(F.max(x).alias(x) for x in ("k", "c", "m")))
    graph = merged.join(known.where("not any_bad and n > 0"), F.col("node") == F.col("k_node"))
    return done, scratch.put(graph.select("node", "needs", "k", F.greatest("c", "g").alias("c"), F.greatest("m", "g").alias("m")))


def _followed(chain: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of calls that need one other each, led to the far end of their chain by pointer doubling; open: there is none, it runs into a cycle."""
    is_in = chain.select(F.col("node").alias("t_node")).distinct()
    now = scratch.put(chain.join(is_in, F.col("needs") == F.col("t_node"), "left").select(*chain.columns, F.col("t_node").isNotNull().alias("open")))
    reach, last = 1, False
    while not last and (n := now.where("open").count()):
        last = reach >= n  # no chain that ends can have more calls left than are open and were passed
        k, c, m = _after("k", "c", "m")
        step = now.where("open").join(_far(now), F.col("needs") == F.col("t_node")).select("node", F.col("t_needs").alias("needs"), k.alias("k"), c.alias("c"), m.alias("m"), F.col("t_open").alias("open"))
        before, now, reach = now, scratch.put(step.unionByName(now.where("not open"))), 2 * reach
        scratch.drop(before)
    return now


def call_levels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, level of the calls with references in conversations where some call needs a later one.

    edges: node, needs (both structs that tell a call), backward (the call it needs comes before it). A call that
    needs a later one, or one that has to be moved, has to be moved: its level is one above the highest of those that
    it needs and that are moved, 1 if there is none. Level null is in or behind a cycle. All other calls have level 0,
    and (level, turn, place) orders a conversation topologically. Rounds, of a few tables each, grow with the
    logarithm of the longest chain of calls that need one other each, and with how many calls in a row need several.
    """
    forward = edges.where(~F.col("backward")).select(F.col("node.conv").alias("f_conv")).distinct()
    asked = scratch.put(edges.distinct().join(forward, F.col("node.conv") == F.col("f_conv"), "left_semi"))
    nodes = asked.select(F.col("node").alias("t_node")).distinct()
    none = F.lit(None).cast("int")
    rows = asked.join(nodes, F.col("needs") == F.col("t_node"), "left").select("node", F.col("t_node").alias("needs"), F.lit(1).alias("k"), (~F.col("backward")).cast("int").alias("c"), none.alias("m"), F.lit(False).alias("bad"))
    found, behind = [], []
    while True:
        done, graph = _settled(rows, scratch)
        found.append(done)
        degree = graph.groupBy(F.col("node").alias("d_node")).agg(F.count("*").alias("n"))
        counted = scratch.put(graph.join(degree, F.col("node") == F.col("d_node")).drop("d_node"))
        n_done, n_one, n_more = done.count(), *counted.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1)).first()
        if not n_one and not n_done:  # what is left needs what is left
            found.append(counted.select("node").distinct().withColumn("level", none))
            break
        chains = _followed(counted.where("n = 1").drop("n"), scratch)
        found.append(chains.where("open or needs is null").select("node", F.when(~F.col("open"), F.col("c")).alias("level")))
        behind.append(chains.where("not open"))
        if not n_more:
            break
        # References of calls that need several are led to the ends of chains, and end there if their level is known.
        k, c, m = (F.when(F.col("t_node").isNull(), F.col(x)).otherwise(y) for x, y in zip("kcm", _after("k", "c", "m")))
        led = counted.where("n > 1").join(_far(chains), F.col("needs") == F.col("t_node"), "left").select("node", F.when(F.col("t_node").isNull(), F.col("needs")).otherwise(F.col("t_needs")).alias("needs"), k.alias("k"), c.alias("c"), m.alias("m"), F.coalesce("t_open", F.lit(False)).alias("bad"))
        told = led.join(_far(done), F.col("needs") == F.col("t_node"), "left")
        value = F.when(F.col("t_level") > 0, F.greatest(F.col("t_level") + F.col("k"), "m")).otherwise(F.col("c"))
        ends = F.col("t_node").isNotNull()
        rows = scratch.put(told.select("node", F.when(~ends, F.col("needs")).alias("needs"), "k", F.when(ends, value).otherwise(F.col("c")).alias("c"), "m", (F.col("bad") | (ends & F.col("t_level").isNull())).alias("bad")))
    levels = found[-1]
    for more in found[:-1]:
        levels = levels.unionByName(more)
    for chains in reversed(behind):  # the ends of later chains are known before those of earlier ones
        ahead = chains.where("needs is not null").join(_far(levels), F.col("needs") == F.col("t_node"))
        level = F.when(F.col("t_level") > 0, F.greatest(F.col("t_level") + F.col("k"), "m")).when(F.col("t_level") == 0, F.col("c"))
        levels = scratch.put(levels.unionByName(ahead.select("node", level.alias("level"))))
    return levels


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each call, and for each result without one.

    messages: conv_id, turn, role, content, tool_calls, tool_call_id. Columns: conv_id, call_id, turn, place, name,
    level, status (linked, unanswered, early, cycle, orphan), errors, json. (level, turn, place) orders a
    conversation's calls topologically. early: the result stands before its call. Of calls that share an identifier
    the first gets the first result, the second the second, and so on; the later ones have the error id:repeated, and
    references mean the first. Calls and results without an identifier have rows of their own, unanswered and orphan.
    errors also names references to unknown calls. json holds arguments, id, name, result. A null conversation is one
    of its own, as is an empty one; messages of other roles, null or empty texts and repeated rows make no further
    calls; an empty table gives none.
    """
    messages = messages.select("conv_id", "turn", "role", "content", "tool_calls", "tool_call_id")
    scratch = Scratch(messages.sparkSession, "chat")
    calls = scratch.put(extract_calls(messages))
    results = extract_results(messages)
    node = F.struct("conv", "id", "nth")
    refs = calls.select("conv", "turn", "place", node.alias("node"), F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$([^"\\]+)"'), 1))).alias("ref"))
    known = calls.where("nth = 1").select(F.col("conv").alias("k_conv"), F.col("id").alias("k_id"), node.alias("needs"), F.struct("turn", "place").alias("k_at"))
    met = scratch.put(refs.join(known.hint("shuffle_hash"), (F.col("conv") == F.col("k_conv")) & (F.col("ref") == F.col("k_id")), "left").select("node", "needs", (F.col("k_at") < F.struct("turn", "place")).alias("backward")))
    levels = call_levels(met.where(F.col("needs").isNotNull()), scratch).select(F.col("node").alias("l_node"), "level")
    unknown = met.where(F.col("needs").isNull()).groupBy(F.col("node").alias("u_node")).agg(F.count("*").alias("n_unknown"))

    left = calls.withColumn("node", node)
    right = results.select(*(F.col(c).alias(f"r_{c}") for c in ("conv", "conv_id", "id", "nth", "turn")), "content")
    linked = left.join(right.hint("shuffle_hash"), (F.col("conv") == F.col("r_conv")) & (F.col("id") == F.col("r_id")) & (F.col("nth") == F.col("r_nth")), "full")
    linked = linked.join(levels, F.col("node") == F.col("l_node"), "left").join(unknown, F.col("node") == F.col("u_node"), "left")
    called = F.col("node").isNotNull()
    level = F.when(called, F.when(F.col("l_node").isNull(), 0).otherwise(F.col("level")))
    linked = linked.withColumns({"args": F.try_parse_json("arguments"), "at_level": level, "call_id": F.coalesce("id", "r_id")})
    more = F.filter(F.array(F.when(called & F.col("id").isNull(), F.lit("id:missing")), F.when(F.col("id").isNotNull() & (F.col("nth") > 1), F.lit("id:repeated")), F.when(F.col("n_unknown") > 0, F.lit("reference:unknown call"))), lambda e: e.isNotNull())
    errors = F.when(called, F.concat(argument_errors(schemas), more))
    status = F.when(~called, "orphan").when(F.col("at_level").isNull(), "cycle").when(F.col("r_conv").isNull(), "unanswered").when(F.col("r_turn") < F.col("turn"), "early").otherwise("linked")
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("x")))), F.lit('{"x":null}'))
    value = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_extract(quoted(c), r'(?s)^\{"x":(.*)\}$', 1))
    given = F.coalesce(F.to_json("args"), value("arguments"))
    serial = F.concat(F.lit('{"arguments":'), given, F.lit(',"id":'), value("call_id"), F.lit(',"name":'), value("name"), F.lit(',"result":'), value("content"), F.lit("}"))
    conv_id = F.when(called, F.col("conv_id")).otherwise(F.col("r_conv_id"))
    return linked.select(conv_id.alias("conv_id"), "call_id", F.coalesce("turn", "r_turn").alias("turn"), F.coalesce("place", F.lit(0)).alias("place"), "name", F.col("at_level").alias("level"), status.alias("status"), errors.alias("errors"), serial.alias("json"))
