"""Chat formatting with tool calls linked to their results.

A message may carry tool calls (``<tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>``
in its text) and tool messages their results (``{"tool_call_id", "content"}``).  Calls and results
are hash-joined by conversation and identifier; where an identifier is used again, a result belongs
to the latest call before it.  Events are put in topological order: a result comes after its
call, a call after the results it depends on; otherwise turns keep their order.  Chains of
calls are followed by pointer doubling, so their length counts by its logarithm.
Arguments are checked against a schema per tool, and every message is written as canonical JSON:
keys sorted, no spaces, text as it is.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import land, settle

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
PART_TURNS = 64     # turns of a conversation that one row holds
PART_ROWS = 512     # events of such a part before it is cut into chunks
BLOCK_TURNS = 1024  # turns in which the calls of one identifier are looked up together

TYPES = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None),
}


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats are written as integers."""
    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` departs from the schema: type, enum, bounds, required and further keys, items."""
    found, kind = [], schema.get("type")
    if kind:
        kinds = kind if isinstance(kind, list) else [kind]
        right = any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds)
        if not right and not ("integer" in kinds and isinstance(value, float) and value.is_integer()):
            return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not listed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{at}: out of bounds")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        found.append(f"{at}: length")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: not known")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{at}[{i}]")
    return found


def events(messages: DataFrame) -> DataFrame:
    """One row per message, call and result: conv_id, turn, seat, kind, call_id, name, body, depends_on.

    ``messages`` has conv_id, turn, role and text.  A result is a message of role ``tool`` whose
    text is an object with ``tool_call_id``; calls are taken out of their message's text.
    """
    rows = messages.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    result_id = F.get_json_object("text", "$.tool_call_id")
    is_result = (F.col("role") == "tool") & result_id.isNotNull()
    body = F.when(is_result, F.coalesce(F.get_json_object("text", "$.content"), F.lit(""))).otherwise(F.trim(F.regexp_replace("text", CALL, "")))
    said = rows.select(
        "conv_id", "turn", F.lit(0).alias("seat"), F.when(is_result, "result").otherwise("message").alias("kind"), "role",
        F.when(is_result, result_id).alias("call_id"), F.lit(None).cast("string").alias("name"), body.alias("body"),
        F.array().cast("array<string>").alias("depends_on"),
    )
    blocks = rows.filter(F.col("text").contains("<tool_call>")).select(
        "conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("seat", "raw")
    )
    calls = blocks.select(
        "conv_id", "turn", (F.col("seat") + 1).alias("seat"), F.lit("call").alias("kind"), "role",
        F.get_json_object("raw", "$.id").alias("call_id"), F.get_json_object("raw", "$.name").alias("name"), F.trim("raw").alias("body"),
        F.coalesce(F.from_json(F.get_json_object("raw", "$.depends_on"), "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    )
    return said.union(calls)


ID = ["talk", "call_id"]


def as_of(asks: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows (talk, call_id, turn, nid): the call that an identifier names at a turn.

    That is the latest call of the identifier at or before the turn, else its first one.  Turns are
    taken in blocks, so an identifier that is used throughout a long talk is not one task.
    """
    pos = F.struct("turn", "seat", "nid")
    both = calls.select(*ID, "turn", F.lit(0).alias("side"), pos.alias("pos"))
    both = both.union(asks.select(*ID, "turn", F.lit(1), F.lit(None).cast(both.schema["pos"].dataType)).distinct())
    both = both.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy(*ID, "block").orderBy("turn", "side", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("here", F.last("pos", ignorenulls=True).over(inside)).filter("side = 1")
    blocks = Window.partitionBy(*ID).orderBy("block")
    ends = both.groupBy(*ID, "block").agg(F.max("pos").alias("last"), F.min("pos").alias("first")).select(
        *ID, "block", F.max("last").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("first").over(Window.partitionBy(*ID)).alias("first"),
    )
    return here.join(ends, [*ID, "block"]).select(*ID, "turn", F.coalesce("here", "before", "first")["nid"].alias("nid")).filter("nid is not null")


def chains(state: DataFrame) -> DataFrame:
    """Rows (nid, to, far, steps) of the calls with one need: the first call on their way that has none or
    several (``to``), the latest turn told on the way, and its length.

    In every round a call takes over the pointer of the call it points to.  Calls that still point
    to a call with one need once the rounds exceed all lengths are on a cycle or behind one.
    """
    single = state.filter("many = 1")
    current = settle(
        single.join(state.select(F.col("nid").alias("one"), F.greatest("turn", "result_turn").alias("far"), (F.coalesce("many", F.lit(0)) == 1).alias("goes_on")), "one")
        .select("nid", F.col("one").alias("to"), "far", F.lit(1).cast("long").alias("steps"), "goes_on")
    )
    reach, most = 1, current.count()
    while reach <= most and not current.filter("goes_on").isEmpty():
        ahead = current.select(*[F.col(c).alias(f"__{c}") for c in current.columns])
        moved = current.filter("goes_on").join(ahead, F.col("to") == F.col("__nid")).select(
            "nid", F.col("__to").alias("to"), F.greatest("far", "__far").alias("far"), (F.col("steps") + F.col("__steps")).alias("steps"), F.col("__goes_on").alias("goes_on")
        )
        current = settle(moved.union(current.filter("not goes_on")))
        reach *= 2
    return current.filter("not goes_on").drop("goes_on")


def readiness(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (nid, ready, told, depth): the turn at which a call has all it needs, and its results are there.

    Calls without needs come first; chains follow in one step; calls of several needs as soon as
    these are ready, as many rounds as such calls stand behind each other.  Calls on a cycle or
    behind one have no row.
    """
    told = lambda ready: F.greatest(ready, "result_turn").alias("told")
    done = state.filter("many is null").select("nid", F.col("turn").alias("ready"), told(F.col("turn")), F.lit(0).cast("long").alias("depth"))
    waiting = state.filter("many is not null")
    if waiting.isEmpty():
        return done
    done, way = settle(done), chains(state).join(state.select("nid", "turn", "result_turn"), "nid")
    several = waiting.filter("many > 1").select("nid", "turn", "result_turn", "many").join(edges, "nid")
    while True:
        known = done.select(F.col("nid").alias("__nid"), F.col("told").alias("__told"), F.col("depth").alias("__depth"))
        ready = F.greatest("turn", "far", "__told")
        one = way.join(known, F.col("to") == F.col("__nid")).select("nid", ready.alias("ready"), told(ready), (F.col("__depth") + F.col("steps")).alias("depth"))
        met = several.join(known, F.col("need") == F.col("__nid")).groupBy("nid", "turn", "result_turn", "many").agg(
            F.count(F.lit(1)).alias("there"), F.max("__told").alias("latest"), F.max("__depth").alias("__depth")
        ).filter("there = many")
        ready = F.greatest("turn", "latest")
        both = one.union(met.select("nid", ready.alias("ready"), told(ready), (F.col("__depth") + 1).alias("depth")))
        fresh = settle(both.join(done.select("nid"), "nid", "left_anti"))
        if fresh.isEmpty():
            return done
        done = settle(done.union(fresh))


def linked(events: DataFrame) -> DataFrame:
    """Events with ``linked``, ``at`` (the turn they are written at), ``depth`` and ``cyclic``.

    A call is written at its own turn or once all results that it needs are there; a result at its
    own turn or once its call is written.  A need names the latest call of that identifier up to
    the turn of the call that has it, else the first; a need that names no call holds nobody
    up.  Calls on a cycle keep their turn and are marked.
    """
    events = events.withColumn("talk", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    calls = events.filter("kind = 'call' and call_id is not null").groupBy(*ID, "turn", "seat").agg(
        F.array_distinct(F.flatten(F.collect_set("depends_on"))).alias("needs")
    )
    calls = settle(calls.withColumn("nid", F.monotonically_increasing_id()))
    results = events.filter("kind = 'result'").select(*ID, "turn").distinct()
    needs = calls.select("nid", "talk", "turn", F.explode("needs").alias("call_id")).filter("call_id is not null")
    named = settle(as_of(results.union(needs.select(*ID, "turn")), calls))
    edges = settle(needs.join(named.withColumnRenamed("nid", "need"), [*ID, "turn"]).select("nid", "need").distinct())
    answered = results.join(named, [*ID, "turn"]).groupBy("nid").agg(F.min("turn").alias("result_turn"))
    state = calls.select("nid", "turn").join(answered, "nid", "left").join(
        edges.groupBy("nid").agg(F.count(F.lit(1)).alias("many"), F.min("need").alias("one")), "nid", "left"
    )
    state = settle(state)
    times = readiness(state, edges).drop("told")
    found = state.select("nid", F.col("result_turn").isNotNull().alias("__answered")).join(times, "nid", "left")
    own = calls.select(*ID, "turn", "seat", "nid").join(found, "nid").select(F.lit("call").alias("kind"), *ID, "turn", "seat", "__answered", "ready", "depth")
    told = named.join(results, [*ID, "turn"]).join(found, "nid").select(F.lit("result").alias("kind"), *ID, "turn", F.lit(0).alias("seat"), "__answered", "ready", "depth")
    keys = ["kind", *ID, "turn", "seat"]
    met = own.union(told).withColumn("__met", F.lit(True)).hint("shuffle_hash")
    joined = events.join(met, keys, "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    at = F.when(is_call | is_result, F.greatest("turn", F.coalesce("ready", "turn"))).otherwise(F.col("turn"))
    return joined.select(
        "conv_id", "turn", "seat", "kind", "role", "call_id", "name", "body",
        F.when(is_call, F.coalesce("__answered", F.lit(False))).when(is_result, F.coalesce("__met", F.lit(False))).alias("linked"),
        at.alias("at"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        (is_call & F.col("__met").isNotNull() & F.col("ready").isNull()).alias("cyclic"),
    )


def _write(schemas: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = json.loads(schemas)
        for batch in batches:
            texts, bad = [], []
            for kind, role, call_id, name, body, is_linked, cyclic in zip(*(batch.column(i).to_pylist() for i in range(1, 8))):
                found: list[str] = []
                if kind == "call":
                    try:
                        call = json.loads(body)
                        call = call if isinstance(call, dict) else {}
                    except ValueError:
                        call, found = {}, ["$: not JSON"]
                    arguments = call.get("arguments", {})
                    if isinstance(arguments, str):
                        try:
                            arguments = json.loads(arguments)
                        except ValueError:
                            found.append("$.arguments: not JSON")
                    if name not in known:
                        found.append("no such tool")
                    elif not found:
                        found = problems(arguments, known[name])
                    found += ["no id"] * (call_id is None) + ["no result"] * (not is_linked) + ["cycle"] * bool(cyclic)
                    message = {"role": role, "tool_call": {"id": call_id, "name": name, "arguments": arguments}}
                elif kind == "result":
                    found = [] if is_linked else ["no call"]
                    message = {"role": "tool", "tool_call_id": call_id, "content": body}
                else:
                    message = {"role": role, "content": body}
                texts.append(canonical(message))
                bad.append("; ".join(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(bad, pa.string())], names=["place", "message", "problems"]
            )

    return run


def messages(conversations: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message, call and result, in canonical JSON, with what is wrong with it."""
    rows = linked(events(conversations)).select(
        F.struct("conv_id", "at", "depth", "turn", F.when(F.col("kind") == "result", 1).otherwise(0).alias("late"), "seat", "kind", "linked").alias("place"),
        "kind", "role", "call_id", "name", "body", "linked", "cyclic",
    )
    place = rows.schema["place"].dataType.simpleString()
    return rows.mapInArrow(_write(json.dumps(schemas)), f"place {place}, message string, problems string").select("place.*", "message", "problems")


ORDER = ("at", "depth", "late", "turn", "seat", "message", "problems")


def chunked(rows: DataFrame) -> DataFrame:
    """Rows of wide parts in their order, cut into chunks (``deal``) of ``PART_ROWS`` events.

    Equal rows are counted once, as ``times``; what is left is laid by range, and a row's place is
    the events of the ranges before its own and of the rows before it in its range.
    """
    own = ["conv_id", "part"]
    once = rows.groupBy(*own, *ORDER, "kind", "linked").agg(F.count(F.lit(1)).alias("times"))
    laid = settle(once.repartitionByRange(*own, *ORDER).withColumn("range", F.spark_partition_id()))
    ranges = laid.groupBy(*own, "range").agg(F.sum("times").alias("many"))
    ahead = Window.partitionBy(*own).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("conv_id").alias("__c"), F.col("part").alias("__p"), F.col("range").alias("__r"), F.coalesce(F.sum("many").over(ahead), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy(*own, "range").orderBy(*ORDER, "kind", "linked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = laid.withColumn("end", F.sum("times").over(inside)).join(
        ranges, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")) & (F.col("range") == F.col("__r"))
    ).withColumn("end", F.col("end") + F.col("before")).withColumn("start", F.col("end") - F.col("times"))
    # Copies of a row may reach over several chunks.
    first, last = F.floor(F.col("start") / PART_ROWS), F.floor((F.col("end") - 1) / PART_ROWS)
    cut = placed.withColumn("deal", F.explode(F.sequence(first, last)))
    held = F.least("end", (F.col("deal") + 1) * PART_ROWS) - F.greatest("start", F.col("deal") * PART_ROWS)
    return cut.withColumn("times", held).select(*own, "deal", *ORDER, "kind", "linked", "times")


def chat_format(conversations: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Conversations as canonical JSON: ``conv_id``, ``part``, ``deal``, ``n_messages``, ``n_calls``, ``n_linked``,
    ``n_invalid``, ``problems`` (of calls and results, in order), ``messages`` (a JSON array).

    A part holds ``PART_TURNS`` turns, so a conversation of any length never meets in one task; a
    part of more than ``PART_ROWS`` events is cut further into chunks, numbered by ``deal``, so that
    parts and chunks in their order give the conversation.  Null roles and
    texts count as empty, null turns as 0; messages without text and calls are left out; a null
    conv_id is a conversation of its own kind.  Repeated rows stay.  An unreadable call is kept with empty
    arguments and reported.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = messages(conversations, schemas).filter("kind != 'message' or message not like '{\"content\":\"\",%'")
    rows = land(rows.withColumn("part", F.floor(F.col("at") / PART_TURNS)), "events")
    size = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("many"))
    wide = settle(size.filter(F.col("many") > PART_ROWS))
    split = rows.join(wide.withColumnsRenamed({"conv_id": "__c", "part": "__p"}), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")), "left")
    whole = split.filter("many is null").withColumns({"deal": F.lit(0).cast("long"), "times": F.lit(1).cast("long")})
    dealt = whole.select("conv_id", "part", "deal", *ORDER, "kind", "linked", "times")
    if not wide.isEmpty():
        dealt = dealt.union(chunked(split.filter("many is not null")))
    is_call = F.col("kind") == "call"
    held = dealt.groupBy("conv_id", "part", "deal").agg(
        F.sort_array(F.collect_list(F.struct(*ORDER, "times"))).alias("held"), F.sum("times").alias("n_messages"),
        F.sum(F.when(is_call, F.col("times")).otherwise(0)).alias("n_calls"),
        F.sum(F.when(is_call & F.col("linked"), F.col("times")).otherwise(0)).alias("n_linked"),
        F.sum(F.when(F.col("problems") != "", F.col("times")).otherwise(0)).alias("n_invalid"),
    ).withColumn("held", F.flatten(F.transform("held", lambda h: F.array_repeat(h, h["times"].cast("int")))))
    return held.select(
        "conv_id", "part", "deal", "n_messages", "n_calls", "n_linked", "n_invalid",
        F.array_join(F.filter(F.transform("held", lambda h: h["problems"]), lambda p: p != ""), " | ").alias("problems"),
        F.concat(F.lit("["), F.array_join(F.transform("held", lambda h: h["message"]), ","), F.lit("]")).alias("messages"),
    )


# The tools that ``with_lookups`` lets the given conversations call.
LOOKUPS = {
    "lookup": {
        "type": "object", "required": ["conv", "turn", "words"], "additionalProperties": False,
        "properties": {"conv": {"type": "integer", "minimum": 0}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 5}},
    }
}


def with_lookups(conversations: DataFrame) -> DataFrame:
    """The conversations with a tool call derived from every user turn, and its result from the
    assistant turn that follows; a user turn without an answer leaves its call without result.

    Each call depends on the one two turns before, so a talk is a chain of calls.  Turns or
    conversations that are null are written as "null" in the identifiers; repeated rows stay.
    """
    spoken = conversations.select("conv_id", "turn", "role", "text")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    asked = spoken.filter("role = 'user'").select(
        "conv_id", "turn", F.lit("assistant").alias("role"),
        F.format_string('<tool_call>{"id": "call_%d_%d", "name": "lookup", "arguments": {"words": %d, "turn": %d, "conv": %d}, "depends_on": ["call_%d_%d"]}</tool_call>',
            "conv_id", "turn", words, "turn", "conv_id", "conv_id", F.col("turn") - 2,
        ).alias("text"),
    )
    told = spoken.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.lit("tool").alias("role"),
        F.format_string('{"tool_call_id": "call_%d_%d", "content": "%d words"}', "conv_id", F.col("turn") - 1, words).alias("text"),
    )
    return spoken.union(asked).union(told)
