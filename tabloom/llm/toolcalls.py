"""Tool-call linking, DataFrame and SQL expressions only.

Input: calls (conv_id, pos, call_id, name, arguments JSON, after: ids of calls
whose results it needs) and results (conv_id, pos, call_id, content).  Output:
one row per call with its result, its place in a topological order, what is
wrong with its arguments, and both as canonical JSON.

* Linking is a hash join on (conv_id, call_id).  Repeated ids are reduced to
  their first row before the join (map-side combined), so copies never multiply.
* Order: a call's key is (order_pos, order_hop), from its own position and, for
  a dependency that stands later, the dependency's key one hop on.  Sorting a
  conversation by (order_pos, order_hop, pos, call_id) puts every dependency
  first.  Calls whose dependencies all stand earlier keep their own position, so
  only the others move in the rounds.  Calls on a cycle, and all that need one, are
  found first: what is left when calls without open dependencies are peeled off.
  They are ``cyclic`` and have no place (null keys).  Rounds are as many as the
  longest chain, in either part.
* Validation: the schemas are a parameter (a dict, part of the plan); the
  arguments are parsed as VARIANT and each parameter's type is looked up.
* Canonical JSON: object keys in order, no white space (VARIANT keeps objects
  sorted by key).

No window and no group ever holds a conversation, so one with a third of all
rows is as cheap as many small ones.

Null ids, names or arguments: a call without conv_id or call_id is dropped from
linking but kept with status ``no_id``; null or broken arguments are
``invalid: not a JSON object``; unknown names ``invalid: unknown tool``; calls
without result have null content; results without call are counted by
``orphan_results``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import written

# JSON types of VARIANT schema names, for the types a schema can ask for
TYPES = {"integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "string": ["STRING"],
         "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def canonical(json: Column) -> Column:
    """Canonical text of a JSON value; null where it does not parse."""
    return F.to_json(F.try_parse_json(json))


def _type_ok(value: Column, kind: str) -> Column:
    name = F.schema_of_variant(value)
    out = F.lit(False)
    for prefix in TYPES[kind]:
        out = out | name.startswith(prefix)
    return out


def problems(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Array of what is wrong with a call's arguments; empty if nothing is.

    ``schemas``: tool name to {"required": [...], "properties": {param: {"type", "enum",
    "minimum", "maximum"}}}.
    """
    parsed = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(schemas.items()):
        found = []
        for param, rule in sorted(schema.get("properties", {}).items()):
            path = f"$.{param}"
            value = F.try_variant_get(parsed, path, "variant")
            wrong = F.when(~_type_ok(value, rule["type"]), f"{param}: not {rule['type']}")
            if "enum" in rule:
                wrong = wrong.when(~F.try_variant_get(parsed, path, "string").isin(list(rule["enum"])),
                                   f"{param}: not allowed")
            if "minimum" in rule:
                wrong = wrong.when(F.try_variant_get(parsed, path, "double") < rule["minimum"], f"{param}: too small")
            if "maximum" in rule:
                wrong = wrong.when(F.try_variant_get(parsed, path, "double") > rule["maximum"], f"{param}: too large")
            found.append(F.when(value.isNotNull(), wrong))
            if param in schema.get("required", ()):
                found.append(F.when(value.isNull(), f"{param}: missing"))
        known = F.array(*(F.lit(p) for p in sorted(schema.get("properties", {})))).cast("array<string>")
        keys = F.json_object_keys(F.to_json(parsed))
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(": unknown")))
        listed = F.filter(F.array(*found), lambda p: p.isNotNull()) if found else none
        out = F.when(name == tool, F.concat(listed, extra)).otherwise(out)
    return F.when(~is_object, F.array(F.lit("not a JSON object"))).otherwise(out)


def _first(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The first row (by position, then content) of each (conv_id, call_id), and how many there are."""
    s = F.min(F.struct(*columns)).alias("s")
    return rows.groupBy("conv_id", "call_id").agg(s, F.count("*").alias("copies")).select(
        "conv_id", "call_id", "copies", "s.*")


def order_keys(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, order_pos, order_hop and cyclic of every call.

    ``calls``: conv_id, call_id, pos, after (array of call ids), one row per id.
    """
    edges = calls.select("conv_id", "call_id", "pos", F.explode(F.array_distinct("after")).alias("dep"))
    place = calls.select("conv_id", F.col("call_id").alias("dep"), F.col("pos").alias("dep_pos"))
    edges = written(edges.join(place, ["conv_id", "dep"]).select("conv_id", "call_id", "pos", "dep", "dep_pos"), "edges")
    start = F.struct(F.col("pos").alias("p"), F.lit(0).alias("h"))
    if not edges.where("dep_pos >= pos").limit(1).count():
        # every dependency stands earlier: no key moves and there is no cycle
        return calls.select("conv_id", "call_id", F.col("pos").alias("order_pos"), F.lit(0).alias("order_hop"), F.lit(False).alias("cyclic"))
    # calls on a cycle or in need of one: peel off the edges to calls without an edge of their own until none goes
    core, n, before = edges.select("conv_id", "call_id", "dep"), edges.count(), -1
    while n and n != before:
        alive = core.select("conv_id", F.col("call_id").alias("dep")).distinct()
        core, before = written(core.join(alive, ["conv_id", "dep"], "left_semi"), "core", n), n
        n = core.count()
    cyclic = core.select("conv_id", "call_id").distinct()
    free = written(edges.join(cyclic, ["conv_id", "call_id"], "left_anti"), "edges", edges.count())
    # keys of the calls with dependencies; all others keep their own place
    own = free.groupBy("conv_id", "call_id").agg(F.first("pos").alias("pos")).select("conv_id", "call_id", start.alias("k"))
    keys, moving, size = written(own, "order"), 1, free.count()
    while moving:
        dep = keys.select("conv_id", F.col("call_id").alias("dep"), F.col("k").alias("dk"))
        need = free.join(dep, ["conv_id", "dep"], "left").groupBy("conv_id", "call_id").agg(F.max(F.struct(
            F.coalesce("dk.p", "dep_pos").alias("p"), (F.coalesce("dk.h", F.lit(0)) + 1).alias("h"))).alias("need"))
        up = F.col("need") > F.col("k")
        new = written(keys.join(need, ["conv_id", "call_id"]).select(
            "conv_id", "call_id", F.when(up, F.col("need")).otherwise(F.col("k")).alias("k"), up.alias("moved")), "order", size)
        keys, moving = new.select("conv_id", "call_id", "k"), new.where("moved").limit(1).count()
    key = F.coalesce(F.col("k"), start)
    return calls.select("conv_id", "call_id", "pos").join(keys, ["conv_id", "call_id"], "left") \
        .join(cyclic.withColumn("c", F.lit(True)), ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", F.when(F.col("c").isNull(), key["p"]).alias("order_pos"),
            F.when(F.col("c").isNull(), key["h"]).alias("order_hop"), F.col("c").isNotNull().alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per distinct call: order, status, problems and canonical JSON of call and result."""
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select("conv_id", "pos", "call_id", "name", "arguments",
                         F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    named = written(_first(calls.where(has_id), ["pos", "name", "arguments", "after"]), "calls")
    answers = _first(results.select("conv_id", "call_id", "pos", "content").where(has_id), ["pos", "content"]).select(
        "conv_id", "call_id", F.col("pos").alias("result_pos"), "content")
    keys = order_keys(named)
    joined = named.join(keys, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    out = joined.withColumn("wrong", problems(F.col("name"), F.col("arguments"), schemas))
    out = out.withColumn("status", F.when(F.col("cyclic"), "cyclic").when(F.size("wrong") > 0, "invalid")
                         .when(F.col("result_pos").isNull(), "no_result")
                         .when(F.col("result_pos") < F.col("pos"), "result_before_call").otherwise("ok"))
    columns = ["conv_id", "call_id", "name", "copies", "order_pos", "order_hop", "status"]
    linked = out.select(*columns, F.concat_ws("; ", "wrong").alias("problems"),
                        canonical_call(F.col("call_id"), F.col("name"), F.col("arguments")).alias("call_json"),
                        canonical_result(F.col("call_id"), F.col("content")).alias("result_json"))
    lost = calls.where(~has_id).select(
        "conv_id", "call_id", "name", F.lit(1).cast("long").alias("copies"), F.col("pos").alias("order_pos"),
        F.lit(0).alias("order_hop"), F.lit("no_id").alias("status"), F.lit("").alias("problems"),
        canonical_call(F.col("call_id"), F.col("name"), F.col("arguments")).alias("call_json"),
        F.lit(None).cast("string").alias("result_json"))
    return linked.unionByName(lost)


def canonical_call(call_id: Column, name: Column, arguments: Column) -> Column:
    """{"arguments":...,"id":...,"name":...}; broken arguments are kept as a JSON string."""
    args = F.coalesce(canonical(arguments), quoted(arguments), F.lit("null"))
    return F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), F.coalesce(quoted(call_id), F.lit("null")),
                    F.lit(',"name":'), F.coalesce(quoted(name), F.lit("null")), F.lit("}"))


def canonical_result(call_id: Column, content: Column) -> Column:
    """{"content":...,"id":...}, null without a result; content that is JSON stays a value."""
    return F.concat(F.lit('{"content":'), F.coalesce(canonical(content), quoted(content)),
                    F.lit(',"id":'), quoted(call_id), F.lit("}"))


def quoted(text: Column) -> Column:
    """A string as a JSON string."""
    body = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substr(body, F.lit(6), F.char_length(body) - 6))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose (conv_id, call_id) no call has."""
    ids = calls.select("conv_id", "call_id").distinct()
    return results.join(ids, ["conv_id", "call_id"], "left_anti")


# ------------------------------------------------------------------ calls that Spark derives from conversations

SCHEMAS = {
    "search": {"required": ["limit", "query"], "properties": {
        "limit": {"type": "integer", "minimum": 1, "maximum": 40}, "query": {"type": "string"}}},
    "lookup": {"required": ["key"], "properties": {"key": {"type": "string"}, "exact": {"type": "boolean"}}},
    "measure": {"required": ["unit", "value"], "properties": {
        "unit": {"type": "string", "enum": ["chars", "words"]}, "value": {"type": "number"}, "of": {"type": "string"}}},
}


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User and system turns as calls, assistant turns as results, with the whole texts in their JSON.

    The tool, its arguments (valid or not) and its dependencies follow from the length n of the turn's text:
    on the call two turns earlier (n % 3 = 0), two turns later (n % 5 = 0) and four turns later (n % 7 = 0),
    so there are chains in both directions and cycles.  An assistant turn answers the turn before it, or
    (n % 11 = 0) the one after it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(text)

    def call(step):
        return F.concat(F.lit("call-"), (F.col("turn") + step).cast("string"))

    whole = quoted(text)
    search = F.concat(F.lit('{ "query": '), whole, F.lit(', "limit": '), F.pmod(n, F.lit(45)).cast("string"), F.lit(" }"))
    lookup = F.concat(F.lit('{"key":'), whole, F.lit(',"exact":'),
                      F.when(n % 7 == 0, '"yes"').when(n % 2 == 0, "true").otherwise("false"), F.lit("}"))
    measure = F.concat(F.lit('{"value": '), n.cast("string"), F.lit(', "unit": "'),
                       F.when(n % 5 == 0, "lines").when(n % 2 == 0, "words").otherwise("chars"), F.lit('", "of":'), whole, F.lit("}"))
    kind = F.pmod(n, F.lit(4))
    after = F.array_compact(F.array(*[F.when(n % m == 0, call(step)) for m, step in ((3, -2), (5, 2), (7, 4))]))
    calls = turns.where("role in ('user', 'system')").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("pos"), call(0).alias("call_id"),
        F.when(kind == 0, "search").when(kind == 1, "lookup").when(kind == 2, "measure").otherwise("browse").alias("name"),
        F.when(kind == 0, search).when(kind == 1, lookup).when(kind == 2, measure)
        .otherwise(F.concat(F.lit('{"page":'), whole, F.lit("}"))).alias("arguments"), after.alias("after"))
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.when(n % 11 == 0, call(1)).otherwise(call(-1)).alias("call_id"), F.col("turn").alias("pos"),
        F.concat(F.lit('{"size": '), n.cast("string"), F.lit(', "content": '), whole, F.lit("}")).alias("content"))
    return calls, results


def link_conversations(turns: DataFrame) -> DataFrame:
    """The whole chain over a conversations table."""
    calls, results = derived_calls(turns)
    return link(calls, results, SCHEMAS)
