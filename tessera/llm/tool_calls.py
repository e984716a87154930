"""Chat formatting: tool calls and results are linked, ordered, validated and serialised as canonical JSON.

1. Calls and results, one row each per identifier of a conversation, meet in a shuffled hash join.
2. Calls get topological levels: 0 without dependencies, else one above the highest of them. Chains of single dependencies
   are followed by pointers that double each round; calls with several dependencies get theirs round by round (Kahn). A
   call in or behind a cycle gets none.
3. Arguments are checked against the tool's schema by expressions over the parsed JSON.
4. The record is written with sorted keys, without white space.

Everything is DataFrame operations. ``calls_of`` and ``results_of`` read JSON messages (``{"tool_calls": [...]}``,
``{"tool_call_id": ..., "content": ...}``) and, for plain turns, take each user turn as a call of ``answer`` that depends on
the user turn two before, and the assistant turn after it as the result.

Defined results: of rows that repeat an identifier within a conversation, the least (by turn, then content) stands and
``n_calls``/``n_results`` count them; rows without a conversation, turn or identifier are answered each for itself as
``no identifier``; null texts count as empty; dependencies that no call has are an error of the call and order nothing;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

CALL = "struct<tool_calls: array<struct<id: string, name: string, arguments: variant, after: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"


@dataclass(frozen=True)
class Field:
    """A field of a tool's arguments: its JSON type, and bounds of a number or of a string's length."""

    name: str
    kind: str  # string, integer, number, boolean, array, object
    required: bool = True
    low: float | None = None
    high: float | None = None


SCHEMAS = {"answer": (Field("query", "string", low=1, high=4000), Field("words", "integer", low=1, high=64))}
#: Names of JSON types among Spark's types of variants.
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


def _quoted(c: Column) -> Column:
    """A string as JSON text, or null as ``null``."""
    made = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(made, F.lit(2), F.length(made) - 2))


def _words(text: str) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _turns(messages: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", text.alias("text"))
    is_json = F.ltrim("text").startswith("{")  # most turns are prose, which need not be parsed
    return rows.withColumn("call", F.when(is_json, F.from_json("text", CALL))).withColumn("result", F.when(is_json, F.from_json("text", RESULT)))


def calls_of(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, seq, call_id, name, arguments, after``; ``arguments`` is JSON text."""
    rows = _turns(messages)
    listed = rows.where("call.tool_calls is not null").select("conv_id", "turn", F.posexplode("call.tool_calls").alias("seq", "c"))
    listed = listed.select("conv_id", "turn", "seq", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    plain = rows.where("role = 'user' and call.tool_calls is null and result.tool_call_id is null")
    call_id = lambda back: F.concat(F.lit("call-"), F.col("turn") - back)
    plain = plain.select(
        "conv_id", "turn", F.lit(0).alias("seq"), call_id(0).alias("call_id"), F.lit("answer").alias("name"),
        F.concat(F.lit('{"query":'), _quoted(F.col("text")), F.lit(',"words":'), _words("text"), F.lit("}")).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(call_id(2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    return listed.unionByName(plain)


def results_of(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, call_id, content``."""
    rows = _turns(messages)
    said = rows.where("result.tool_call_id is not null").select("conv_id", "turn", F.col("result.tool_call_id").alias("call_id"), F.col("result.content").alias("content"))
    plain = rows.where("role = 'assistant' and call.tool_calls is null and result.tool_call_id is null")
    return said.union(plain.select("conv_id", "turn", F.concat(F.lit("call-"), F.col("turn") - 1), "text"))


def _chains(single: DataFrame, junctions: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, call_id, anchor, steps`` of calls with one dependency: the first call with none or several that their chain
    of dependencies leads to. Pointers double each round; chains that end in a cycle have no anchor and are left out."""
    ends = junctions.select("conv_id", F.col("call_id").alias("anchor"), F.lit(True).alias("found"))
    at = single.select("conv_id", "call_id", F.col("dep").alias("anchor"), F.lit(1).alias("steps")).join(ends, ["conv_id", "anchor"], "left")
    at = scratch.save(at.select("conv_id", "call_id", "anchor", "steps", F.coalesce("found", F.lit(False)).alias("found")), "chain0")
    k, left, before = 0, at.where("not found").count(), -1
    while left and left != before:
        k += 1
        on = at.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("steps").alias("more"), F.col("found").alias("ends"))
        moved = at.where("not found").join(on, ["conv_id", "anchor"]).select("conv_id", "call_id", F.col("next").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("found"))
        at = scratch.save(at.where("found").union(moved), f"chain{k}")
        scratch.drop(f"chain{k - 1}")
        left, before = at.where("not found").count(), left
    return at.where("found").drop("found")


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, call_id, level, unknown`` of distinct calls: the level, null in or behind a cycle, and unknown dependencies.

    Chains of single dependencies are followed first, in rounds that grow with the logarithm of their length, so that Kahn's
    rounds only step from one call with several dependencies to the next.
    """
    key = ["conv_id", "call_id"]
    ids = calls.select(*key)
    wanted = calls.select(*key, F.explode(F.array_distinct("after")).alias("dep"))
    known = ids.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known"))
    edges = wanted.join(known, ["conv_id", "dep"], "left")
    need = edges.groupBy(*key).agg(F.collect_list(F.when(F.col("known"), F.col("dep"))).alias("deps"), F.count_if(F.col("known").isNull()).alias("unknown"))
    state = ids.join(need, key, "left").select(*key, F.coalesce("deps", F.array().cast("array<string>")).alias("deps"), F.coalesce("unknown", F.lit(0)).alias("unknown"))
    state = scratch.save(state.withColumn("left", F.size("deps").cast("long")), "state")
    single = state.where("left = 1").select(*key, F.col("deps")[0].alias("dep"))
    chains = _chains(single, state.where("left <> 1"), scratch)
    # these tables are written already, and those of Kahn's rounds only if some call has several dependencies
    anchors = chains.union(state.where("left <> 1").select(*key, F.col("call_id").alias("anchor"), F.lit(0).alias("steps")))
    several = state.where("left > 1").select(*key, "left")
    ranked = front = state.where("left = 0").select(*key, F.lit(0).alias("level"))
    if several.take(1):
        # dependencies of calls with several, as the anchors that they hang on and the steps to them
        hung = state.where("left > 1").select(*key, F.explode("deps").alias("dep")).join(anchors.select("conv_id", F.col("call_id").alias("dep"), "anchor", "steps"), ["conv_id", "dep"])
        hung = scratch.save(hung.select(*key, "anchor", "steps"), "hung")
        waiting, k = several.withColumn("high", F.lit(0)), 0
        while front.take(1):
            ranked = ranked.union(front) if k else ranked
            k += 1
            freed = hung.join(front.select("conv_id", F.col("call_id").alias("anchor"), "level"), ["conv_id", "anchor"]).groupBy(*key).agg(F.count("*").alias("n"), F.max(F.col("level") + F.col("steps")).alias("top"))
            after = waiting.join(freed, key, "left").select(*key, (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("high", F.coalesce("top", F.lit(0))).alias("high"))
            after = scratch.save(after, f"waiting{k}")
            front = scratch.save(after.where("left = 0").select(*key, (F.col("high") + 1).alias("level")), f"level{k}")
            waiting = after.where("left > 0")
    ranked = anchors.join(ranked.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("base")), ["conv_id", "anchor"]).select(*key, (F.col("base") + F.col("steps")).alias("level"))
    return state.select(*key, "unknown").join(ranked, key, "left")


def errors(schemas: dict[str, tuple[Field, ...]]) -> Column:
    """What is wrong with ``name`` and ``arguments``, in a fixed order."""
    parsed = F.try_parse_json("arguments")

    def of(fields: tuple[Field, ...]) -> Column:
        found = []
        for f in fields:
            value = F.try_variant_get(parsed, f"$.{f.name}", "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull() | (kind == "VOID")
            size = F.length(F.try_variant_get(parsed, f"$.{f.name}", "string")) if f.kind == "string" else F.try_variant_get(parsed, f"$.{f.name}", "double")
            bad = F.when(absent, F.lit(f"{f.name} is missing") if f.required else None).when(~kind.rlike(KINDS[f.kind]), F.lit(f"{f.name} is not of type {f.kind}"))
            if f.low is not None:
                bad = bad.when(size < f.low, F.lit(f"{f.name} is below {f.low:g}"))
            if f.high is not None:
                bad = bad.when(size > f.high, F.lit(f"{f.name} is above {f.high:g}"))
            found.append(bad)
        allowed = F.array(*[F.lit(f.name) for f in fields])
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")), allowed)), lambda x: F.concat(x, F.lit(" is not known")))
        return F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), extra)

    out = F.array(F.lit("tool is not known"))
    for name, fields in schemas.items():
        out = F.when(F.col("name") == name, of(fields)).otherwise(out)
    return F.when(parsed.isNull(), F.array(F.lit("arguments are not JSON"))).otherwise(out)


def link(calls: DataFrame, results: DataFrame, *, schemas: dict[str, tuple[Field, ...]] = SCHEMAS) -> DataFrame:
    """``conv_id, call_id, name, turn, result_turn, level, n_calls, n_results, status, valid, errors, canonical_json``.

    ``status`` is linked, unanswered, orphan result or no identifier. Ordering by ``level, turn, call_id`` within a conversation is
    a topological order.
    """
    scratch = Scratch(calls.sparkSession, "calls")
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = calls.where(named).groupBy(*key).agg(F.min(F.struct("turn", "seq", "name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
    own = scratch.save(own.select(*key, "c.turn", "c.name", "c.arguments", "c.after", "n_calls"), "calls")
    said = results.where(named).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    said = said.select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    ranked = own.join(levels(own, scratch), key).withColumn("is_call", F.lit(True))
    met = ranked.join(said.hint("shuffle_hash"), key, "full_outer")
    status = F.when(F.col("is_call").isNull(), "orphan result").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    met = met.withColumn("status", status).select(*key, "name", "turn", "arguments", "level", "unknown", "n_calls", "result_turn", "content", "n_results", "status")
    lost = calls.where(~named).select(*key, "name", "turn", "arguments", F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("unknown"), F.lit(1).cast("long").alias("n_calls"), F.lit(None).cast("long").alias("result_turn"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("n_results"), F.lit("no identifier").alias("status"))
    stray = results.where(~named).select(*key, F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("unknown"), F.lit(None).cast("long").alias("n_calls"), F.col("turn").alias("result_turn"), "content", F.lit(1).cast("long").alias("n_results"), F.lit("no identifier").alias("status"))
    met = met.union(lost).union(stray)
    is_call = F.col("n_calls").isNotNull()
    wrong = F.concat(
        F.when(is_call, errors(schemas)).otherwise(F.array().cast("array<string>")),
        F.when(F.col("unknown") > 0, F.array(F.lit("a dependency is not known"))).otherwise(F.array().cast("array<string>")),
        F.when(is_call & F.col("level").isNull() & (F.col("status") != "no identifier"), F.array(F.lit("dependencies form a cycle"))).otherwise(F.array().cast("array<string>")),
    )
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    canonical = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"id":'), _quoted(F.col("call_id")), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"result":'), _quoted(F.col("content")), F.lit("}"),
    )
    made = met.withColumn("wrong", wrong)
    return made.select(
        *key, "name", "turn", "result_turn", "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "status",
        (F.size("wrong") == 0).alias("valid"), F.array_join("wrong", "; ").alias("errors"), canonical.alias("canonical_json"),
    )
