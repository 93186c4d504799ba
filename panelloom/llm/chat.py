"""Tool-call linking in conversations.

Calls and results are joined by identifier, put in an order in which each follows what it depends on,
checked against the schema of their tool and written as canonical JSON, one line for each event.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import discard, put

#: Beginnings of the type names of VARIANT values by JSON type.
TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
    "boolean": ["BOOLEAN"],
    "object": ["OBJECT"],
    "array": ["ARRAY"],
}
Schema = Mapping[str, Mapping[str, tuple[str, bool]]]


def problems(name: Column, arguments: Column, schemas: Schema) -> Column:
    """What is wrong with a call's arguments (JSON text); an empty array if nothing.

    ``schemas``: tool to argument to (JSON type, required). Unknown tools, text that is no JSON object
    or repeats a key, missing, mistyped and unknown arguments are told; a JSON null counts as missing.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    keys = F.json_object_keys(arguments)
    found = F.array(F.lit("unknown tool"))
    for tool, wanted in schemas.items():
        checks = []
        for key, (kind, required) in sorted(wanted.items()):
            part = F.try_variant_get(value, "$['" + key + "']", "variant")
            kind_of = F.schema_of_variant(part)
            given = kind_of.isNotNull() & (kind_of != "VOID")
            right = F.lit(False)
            for start in TYPES[kind]:
                right = right | kind_of.startswith(start)
            check = F.when(given & ~right, F.lit(f"{key}: not {kind}"))
            checks.append(check.when(~given, F.lit(f"{key}: missing")) if required else check)
        unknown = F.transform(
            F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in wanted]))),
            lambda k: F.concat(k, F.lit(": unknown")),
        )
        told = F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), unknown)
        told = F.when(is_object, told).otherwise(F.array(F.lit("arguments: not a JSON object")))
        found = F.when(name == tool, told).otherwise(found)
    return found


def canonical(fields: Mapping[str, Column]) -> Column:
    """JSON with keys in code point order, no spaces, and no entry for a null. VARIANT objects do the same inside."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def _places(calls: DataFrame) -> DataFrame:
    """(conv, call, place, depth, cyclic) of uniquely named calls, each after what it depends on.

    A call starts at its own turn. If one of its ``after`` ends later, it moves behind it, and
    so on along the chain; a round is one join of the calls just moved with their dependents, and
    calls already in order take none. Only a cycle can move on for more steps
    than its conversation has moved calls; its members stay at their turn.
    """
    spark = calls.sparkSession
    state = calls.select(
        "conv", "call", "turn", "answered", F.col("turn").alias("place"), F.lit(0).alias("depth"),
        F.lit(0).alias("hops"), F.lit(False).alias("cyclic"),
    )
    edges = put(calls.select("conv", "call", F.explode("after").alias("parent")).distinct(), "chat-edges")
    path, moved = put(state, "chat-places"), None
    while True:
        state, links = spark.read.parquet(path), spark.read.parquet(edges)
        late = F.coalesce(F.col("answered") > F.col("place"), F.lit(False))
        ends = state.where(~F.col("cyclic")) if moved is None else state.where((F.col("hops") == moved) & ~F.col("cyclic"))
        ends = ends.select(
            F.col("conv").alias("in"),
            F.col("call").alias("of"),
            F.when(late, F.struct(F.col("answered").alias("place"), F.lit(0).alias("depth")))
            .otherwise(F.struct("place", (F.col("depth") + F.col("answered").isNotNull().cast("int")).alias("depth")))
            .alias("end"),
        )
        need = links.join(ends, F.col("conv").eqNullSafe(F.col("in")) & (F.col("parent") == F.col("of")))
        need = need.groupBy("in", F.col("call").alias("of")).agg(F.max("end").alias("end"))
        joined = state.join(need, state["conv"].eqNullSafe(need["in"]) & (state["call"] == need["of"]), "left")
        step = (moved or 0) + 1
        moves = F.coalesce(F.col("end") >= F.struct("place", "depth"), F.lit(False)) & ~F.col("cyclic")
        new = joined.select(
            "conv", "call", "turn", "answered",
            F.when(moves, F.col("end.place")).otherwise(F.col("place")).alias("place"),
            F.when(moves, F.col("end.depth") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(moves, F.lit(step)).otherwise(F.col("hops")).alias("hops"),
            "cyclic",
        )
        new = spark.read.parquet(old := put(new, "chat-places"))
        if new.where(F.col("hops") == step).isEmpty():
            discard(spark, old)
            break
        discard(spark, path)
        path, moved = old, step
        most = new.where("hops > 0").groupBy("conv").agg(F.count("*").alias("movers")).withColumnRenamed("conv", "in")
        turning = new.where(F.col("hops") == step).join(most, F.col("conv").eqNullSafe(F.col("in")))
        turning = turning.where(F.col("hops") > F.col("movers")).select("in").distinct()
        if not turning.isEmpty():
            # What still moves after so many steps depends on a cycle.
            new = new.join(turning, new["conv"].eqNullSafe(turning["in"]), "left")
            stuck = F.col("in").isNotNull() & (F.col("hops") == step) & ~F.col("cyclic")
            new = new.select(
                "conv", "call", "turn", "answered",
                F.when(stuck, F.col("turn")).otherwise(F.col("place")).alias("place"),
                F.when(stuck, 0).otherwise(F.col("depth")).alias("depth"),
                "hops", (F.col("cyclic") | stuck).alias("cyclic"),
            )
            path = put(new, "chat-places")
    return spark.read.parquet(path).select("conv", "call", "place", "depth", "cyclic")


def linked(events: DataFrame, schemas: Schema) -> DataFrame:
    """One row for each event: (conv_id, turn, kind, call_id, place, depth, status, problems, json).

    ``events`` has conv_id, turn, kind (``call``, ``result`` or ``message``), role, call_id, name, arguments (JSON
    text), content and after (call ids of the same conversation that a call waits for). Sorting a conversation by place,
    depth, kind and call_id puts calls behind the results they wait for, and results behind their
    calls; no group of events is gathered for it.

    status of a call: ``answered``, ``open``, ``cyclic``; of a result: ``linked``, ``orphan``; of both ``ambiguous`` if the
    identifier has several calls or results, ``unnamed`` if it is null. Ambiguous and unnamed events stay
    at their turn. Null conversation ids form one conversation, null turns sort first as -1, dependencies on calls
    that are not there or not unique are told as problems. Other columns are not read.
    """
    spark = events.sparkSession
    e = events.select(
        F.col("conv_id").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("at"), "turn", "kind", "role",
        F.col("call_id").alias("call"), "name", "arguments", "content",
        F.array_sort(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("after"),
    )
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    ids = e.where("call is not null").groupBy("conv", "call").agg(
        F.count(F.when(is_call, 1)).alias("calls"),
        F.count(F.when(is_result, 1)).alias("results"),
        F.min(F.when(is_call, F.col("at"))).alias("turn"),
        F.min(F.when(is_result, F.col("at"))).alias("answered"),
        F.min(F.when(is_call, F.col("after"))).alias("after"),
    )
    path = put(ids, "chat-ids")
    ids = spark.read.parquet(path)
    unique = ids.where("calls = 1 and results <= 1")
    known = unique.select(F.col("conv").alias("in"), F.col("call").alias("there"))
    waits = unique.select("conv", "call", F.explode("after").alias("parent"))
    waits = waits.join(known, F.col("conv").eqNullSafe(F.col("in")) & (F.col("parent") == F.col("there")), "left")
    waits = waits.groupBy("conv", "call").agg(
        F.array_sort(F.collect_set(F.when(F.col("there").isNotNull(), F.col("parent")))).alias("after"),
        F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("parent")))).alias("lost"),
    )
    waits = spark.read.parquet(put(waits, "chat-waits"))
    order = unique.drop("after").join(
        waits.select(F.col("conv").alias("in"), F.col("call").alias("of"), "after", "lost"),
        F.col("conv").eqNullSafe(F.col("in")) & (F.col("call") == F.col("of")),
        "left",
    )
    order = order.withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
    places = _places(order.select("conv", "call", "turn", "answered", "after"))
    stats = ids.select(F.col("conv").alias("in"), F.col("call").alias("of"), "calls", "results")
    placed = places.select(F.col("conv").alias("in2"), F.col("call").alias("of2"), "place", "depth", "cyclic")
    lost = waits.select(F.col("conv").alias("in3"), F.col("call").alias("of3"), "lost")
    stats = stats.join(placed, F.col("in").eqNullSafe(F.col("in2")) & (F.col("of") == F.col("of2")), "left")
    stats = stats.join(lost, F.col("in").eqNullSafe(F.col("in3")) & (F.col("of") == F.col("of3")), "left")
    stats = stats.select("in", "of", "calls", "results", "place", "depth", "cyclic", "lost")
    stats = spark.read.parquet(put(stats, "chat-stats")).hint("shuffle_hash")

    found = e.join(stats, e["conv"].eqNullSafe(stats["in"]) & (e["call"] == stats["of"]), "left")
    tool = is_call | is_result
    ambiguous = (F.col("calls") > 1) | (F.col("results") > 1)
    status = (
        F.when(~tool, F.lit("message"))
        .when(F.col("call").isNull(), "unnamed")
        .when(ambiguous, "ambiguous")
        .when(is_call & F.col("cyclic"), "cyclic")
        .when(is_call & (F.col("results") == 1), "answered")
        .when(is_call, "open")
        .when(F.col("calls") == 1, "linked")
        .otherwise("orphan")
    )
    put_at = tool & F.col("place").isNotNull()
    behind = is_result & (F.col("at") <= F.col("place"))
    place = F.when(put_at, F.greatest("place", "at")).otherwise(F.col("at"))
    depth = F.when(put_at & is_call, F.col("depth")).when(put_at & behind, F.col("depth") + 1).otherwise(0)
    lost_calls = F.transform(
        F.coalesce("lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("after "), x, F.lit(": missing"))
    )
    told = F.concat(problems(F.col("name"), F.col("arguments"), schemas), lost_calls)
    value = F.try_parse_json("arguments")
    bad = F.when(value.isNull(), F.col("arguments"))
    call = canonical(
        {"arguments": value, "id": F.col("call"), "name": F.col("name"), "type": F.lit("call"), "unparsed": bad}
    )
    result = canonical({"content": F.col("content"), "id": F.col("call"), "type": F.lit("result")})
    message = canonical({"content": F.col("content"), "role": F.col("role"), "type": F.lit("message")})
    return found.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "kind",
        F.col("call").alias("call_id"),
        place.alias("place"),
        depth.cast("int").alias("depth"),
        status.alias("status"),
        F.when(is_call, told).otherwise(F.array().cast("array<string>")).alias("problems"),
        F.when(is_call, call).when(is_result, result).otherwise(message).alias("json"),
    )


#: The tool that a conversation between a user and an assistant amounts to.
ANSWER: Schema = {"answer": {"question": ("string", True), "turn": ("integer", True)}}


def as_events(turns: DataFrame) -> DataFrame:
    """Turns of a plain conversation as tool events.

    A user's turn calls ``answer`` under the identifier ``c<turn>`` and waits for the call two turns before; an
    assistant's turn is the result of the call one turn before; all else is a message.
    """
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(user, "call").when(reply, "result").otherwise("message").alias("kind"),
        "role",
        F.when(user, name(0)).when(reply, name(1)).alias("call_id"),
        F.when(user, "answer").alias("name"),
        F.when(user, F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("question")))).alias("arguments"),
        F.when(~F.coalesce(user, F.lit(False)), F.col("text")).alias("content"),
        F.when(user & (F.col("turn") >= 2), F.array(name(2))).alias("after"),
    )


#: The rows of ``linked(as_events(conversations), ANSWER)`` in DuckDB SQL, for turns that ascend: no call has to move.
LINKED_SQL = """
WITH e AS (
  SELECT conv_id, turn, role, text, coalesce(turn, -1) AS place,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'c' || turn WHEN 'assistant' THEN 'c' || (turn - 1) END AS call_id,
         CASE WHEN role = 'user' AND turn >= 2 THEN 'c' || (turn - 2) END AS parent
  FROM conversations
), ids AS (
  SELECT conv_id, call_id, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results
  FROM e WHERE call_id IS NOT NULL GROUP BY ALL
)
SELECT e.conv_id, e.turn, e.kind, e.call_id, e.place, 0::INT AS depth,
       CASE WHEN e.kind = 'message' THEN 'message'
            WHEN e.call_id IS NULL THEN 'unnamed'
            WHEN i.calls > 1 OR i.results > 1 THEN 'ambiguous'
            WHEN e.kind = 'call' AND i.results = 1 THEN 'answered'
            WHEN e.kind = 'call' THEN 'open'
            WHEN i.calls = 1 THEN 'linked' ELSE 'orphan' END AS status,
       CASE WHEN e.kind <> 'call' THEN ''
            ELSE concat_ws('; ',
                 CASE WHEN e.text IS NULL THEN 'question: missing' END,
                 CASE WHEN e.turn IS NULL THEN 'turn: missing' END,
                 CASE WHEN e.parent IS NOT NULL AND p.call_id IS NULL AND i.calls = 1 AND i.results <= 1
                      THEN 'after ' || e.parent || ': missing' END) END AS problems,
       CASE e.kind
         WHEN 'call' THEN '{"arguments":{"question":' || to_json(e.text) || ',"turn":' || e.turn || '},"id":"' || e.call_id
                          || '","name":"answer","type":"call"}'
         WHEN 'result' THEN '{"content":' || to_json(e.text) || ',"id":"' || e.call_id || '","type":"result"}'
         ELSE '{"content":' || to_json(e.text) || ',"role":' || to_json(e.role) || ',"type":"message"}' END AS json
FROM e LEFT JOIN ids i ON e.conv_id IS NOT DISTINCT FROM i.conv_id AND e.call_id = i.call_id
LEFT JOIN ids p ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.parent = p.call_id AND p.calls = 1 AND p.results <= 1
"""
