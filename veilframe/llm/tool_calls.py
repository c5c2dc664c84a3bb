"""Tool calls of conversations: linked with their results, ordered, checked and written as canonical JSON.

A call names the call whose result it needs (``after``).  Calls and results are
joined by identifier; how deep a call stands in its chain of needs is found by
pointer doubling, so a chain of n calls takes log n joins; arguments are checked
against the tools' schemas with variant functions.  Results are rows, so a
conversation may hold any share of all calls.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import spread_join
from ..sources.scratch import written

#: Parameter name to its JSON type and whether it has to be there.
Schema = Mapping[str, tuple[str, bool]]

#: How the types of JSON schemas show in the type of a variant.
TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "number": "^(BIGINT|DECIMAL\\(.*\\)|DOUBLE)$",
         "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def argument_problems(name: Column, arguments: Column, tools: Mapping[str, Schema]) -> Column:
    """What is wrong with a call's arguments, in the order of the schema; an empty array if nothing.

    ``bad json`` (no JSON, a key twice), ``no object``, ``missing x``, ``type of x``,
    ``extra x`` and ``unknown tool``.  NULL arguments are an empty object; a parameter
    that is JSON null has the wrong type.
    """
    plain = F.coalesce(arguments, F.lit("{}"))
    value = F.try_parse_json(plain)
    kind = F.schema_of_variant(value)

    def of(schema: Schema) -> Column:
        found = []
        for parameter, (json_type, required) in schema.items():
            own = F.schema_of_variant(F.try_variant_get(value, f"$['{parameter}']", "variant"))
            missing = F.lit(f"missing {parameter}") if required else F.lit(None)
            found.append(F.when(own.isNull(), missing).when(~own.rlike(TYPES[json_type]), F.lit(f"type of {parameter}")))
        known = F.array(*[F.lit(p) for p in schema]) if schema else F.array().cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(plain), F.array().cast("array<string>")), known)),
                            lambda k: F.concat(F.lit("extra "), k))
        return F.concat(F.array_compact(F.array(*found).cast("array<string>")), extra)

    out = F.array(F.lit("unknown tool"))
    for tool, schema in tools.items():
        out = F.when(name == tool, of(schema)).otherwise(out)
    return F.when(value.isNull(), F.array(F.lit("bad json"))).when(~kind.startswith("OBJECT"), F.array(F.lit("no object"))).otherwise(out)


def _shuffled(calls: DataFrame) -> DataFrame:
    """A lookup side that is never sent to the driver for a broadcast, however small its table is.

    Identifiers take few bytes in a file, over a hundred times as many when repeated for the
    parts of a join, and the planner goes by the file.
    """
    return calls.hint("merge")


def call_depths(calls: DataFrame) -> DataFrame:
    """Columns conv_id, call_id and depth: how many calls stand before a call in its chain; NULL on or behind a cycle.

    ``calls`` has one row per conv_id and call_id, both not NULL, and ``after``.  A call
    that needs none, or one that does not exist, has depth 0.  Each round every open
    call skips to the call that its pointer names points at; rounds end when none is
    open, or when none was closed, which only cycles bring about.
    """
    known = calls.select("conv_id", F.col("call_id").alias("up"))
    first = spread_join(calls.select("conv_id", "call_id", F.col("after").alias("up")), _shuffled(known.withColumn("_is", F.lit(True))),
                        ["conv_id", "up"], "left", ["call_id"])
    state = written(first.select("conv_id", "call_id", F.when(F.col("_is"), F.col("up")).alias("up"),
                                 F.when(F.col("_is"), 1).otherwise(0).cast("long").alias("depth")), "call-depths")
    before = None
    while True:
        left = state.where("up IS NOT NULL").count()
        if left == 0 or left == before:
            return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
        before = left
        ahead = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        stepped = spread_join(state.where("up IS NOT NULL"), _shuffled(ahead), ["conv_id", "up"], "inner", ["call_id"]).select(
            "conv_id", "call_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"))
        state = written(state.where("up IS NULL").unionByName(stepped), "call-depths")


def canonical_json(value: Column) -> Column:
    """JSON without blanks and with sorted keys; NULL if it is none."""
    return F.to_json(F.try_parse_json(value))


def link_calls(calls: DataFrame, results: DataFrame, tools: Mapping[str, Schema]) -> DataFrame:
    """Columns conv_id, call_id, turn, depth, copies, problems and json: one row per call, and per result without one.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (a call_id or
    NULL); ``results``: conv_id, call_id, turn, content.  Sorted by conv_id, depth, turn
    and call_id, calls come after all that they need.

    Repeated identifiers: the call, or result, of the smallest turn counts (then by its
    values); ``copies`` says how many calls there were.  Problems beside those of
    ``argument_problems``: ``no result``, ``dangling`` (needs an unknown call), ``cycle``,
    ``early result`` (before its call), ``no call`` and ``no id``.  Calls and results whose
    conv_id or call_id is NULL link with nothing and are all kept.  Other columns are
    not read.  The JSON has the sorted keys arguments, id, name and result; arguments
    that are no JSON stay a text.
    """
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = ["turn", "name", "arguments", "after"]
    calls = calls.select("conv_id", "call_id", *own)
    results = results.select("conv_id", "call_id", F.struct("turn", "content").alias("answer"))
    single = calls.where(has_id).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(*own)).alias("call"), F.count(F.lit(1)).alias("copies"))
    single = written(single.select("conv_id", "call_id", "call.*", "copies"), "calls")
    answers = results.where(has_id).groupBy("conv_id", "call_id").agg(F.min("answer").alias("answer"))
    depths = call_depths(single)
    # One row per identifier on every side: joins without hot keys.
    linked = single.join(_shuffled(depths), ["conv_id", "call_id"]).join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    needed = single.select("conv_id", F.col("call_id").alias("after")).withColumn("_needed", F.lit(True))
    linked = spread_join(linked, _shuffled(needed), ["conv_id", "after"], "left", ["call_id"])
    unknown_id = calls.where(~has_id).select(
        "conv_id", "call_id", *own, F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast(answers.schema["answer"].dataType).alias("answer"), F.lit(None).cast("boolean").alias("_needed"))
    loose = results.where(~has_id).select("conv_id", "call_id", "answer")
    linked = linked.unionByName(unknown_id).unionByName(loose, allowMissingColumns=True)

    is_call = F.col("copies").isNotNull()
    problems = F.concat(
        argument_problems(F.col("name"), F.col("arguments"), tools),
        F.array_compact(F.array(
            F.when(~has_id, "no id"), F.when(F.col("answer").isNull(), "no result"),
            F.when(F.col("after").isNotNull() & F.col("_needed").isNull(), "dangling"), F.when(F.col("depth").isNull(), "cycle"),
            F.when(F.col("answer.turn") < F.col("turn"), "early result"))))
    problems = F.when(is_call, problems).otherwise(F.array_compact(F.array(F.lit("no call"), F.when(~has_id, "no id"))))
    value = F.try_parse_json("arguments")
    # Keys in sorted order; NULL fields are left out.
    with_value = F.to_json(F.struct(value.alias("arguments"), F.col("call_id").alias("id"), "name", F.col("answer.content").alias("result")))
    with_text = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name", F.col("answer.content").alias("result")))
    return linked.select(
        "conv_id", "call_id", F.coalesce("turn", "answer.turn").alias("turn"), "depth", F.coalesce("copies", F.lit(0)).alias("copies"),
        problems.alias("problems"), F.when(value.isNotNull() | F.col("arguments").isNull(), with_value).otherwise(with_text).alias("json"))
