"""Chat formatting: tool calls linked to their results.

Messages have a conversation, an id, a position ``seq`` and a kind (``call``, ``result`` or ``message``). Calls
and results are joined by conversation and call id. Every message depends on at most one other: a result on
its call, any other on the message named in ``after``. The depth in this forest orders the messages: sorting
by (depth, seq, id) is a topological order. Depths come from pointer doubling, logarithmically many joins on
unique keys, so that neither a long conversation nor a hot one is one task's. Arguments are validated against
the schema of their tool, and each message is serialised as canonical JSON: keys sorted, no blanks, text
unescaped but for quotes, backslashes and control characters.

Status of a message: ``linked``, ``unanswered`` (call without result), ``orphan`` (result without call),
``repeated`` (a further call or result of the same call id; the first by seq counts), ``cycle`` (it depends on
itself in the end; its depth is NULL) or ``plain``.

Defined results: a NULL conversation is a value of its own; a message without id is a row of its own and linked
with nothing, whatever its call id (a call is ``unanswered``, a result ``orphan``, any other ``plain``), at depth
0; a turn without number is such a message, of NULL seq, and as a call misses the argument ``turn``; a call or
result without call id is linked with nothing; a dependency on a message that does not exist counts as none; of messages
that repeat their id each keeps its own place, and the others hang on the first of them by (seq, parent); NULL content is JSON null; arguments that are no JSON object are
invalid, and written as text; a tool without schema is invalid; an empty table gives no rows; other columns
are ignored.
"""

import json
import math

from pyspark.sql import functions as F

from tablekeeper.llm.tables import load, staged

SCHEMAS = {
    "reply": {
        "type": "object", "required": ["text", "turn"], "additionalProperties": False,
        "properties": {
            "text": {"type": "string", "minLength": 1, "maxLength": 20_000},
            "turn": {"type": "integer", "minimum": 0},
        },
    },
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def violations(value, schema, path="$"):
    """What a value breaks of a schema (type, enum, bounds, required, properties, items), in order."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (isinstance(value, bool) and kind != "boolean")):
        return [f"{path}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not allowed")
    if isinstance(value, str):
        out += [f"{path}: too short"] * (len(value) < schema.get("minLength", 0))
        out += [f"{path}: too long"] * (len(value) > schema.get("maxLength", math.inf))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{path}: too small"] * (value < schema.get("minimum", -math.inf))
        out += [f"{path}: too large"] * (value > schema.get("maximum", math.inf))
    elif isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += violations(item, schema["items"], f"{path}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{name}: missing" for name in schema.get("required", ()) if name not in value]
        for name in sorted(value):
            if name in known:
                out += violations(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{name}: unknown")
    return out


def canonical(value):
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def checked_arguments(text, schema):
    """(value to write, violations) of a call's arguments."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return text, ["$: no JSON"]
    if schema is None:
        return value, ["$: no schema"]
    return value, violations(value, schema)


def _statuses(messages):
    """Adds ``partner`` (the id of the call that a result belongs to) and ``status``."""
    key = [F.col("conv_id").eqNullSafe(F.col("c_conv")), F.col("call_id") == F.col("c_call")]
    firsts = lambda kind, name: messages.where(
        (F.col("kind") == kind) & F.col("call_id").isNotNull()
    ).groupBy(F.col("conv_id").alias("c_conv"), F.col("call_id").alias("c_call")).agg(
        F.min(F.struct("seq", "msg_id")).alias(name))
    both = firsts("call", "call").join(
        firsts("result", "result").withColumnRenamed("c_conv", "r_conv").withColumnRenamed("c_call", "r_call"),
        F.col("c_conv").eqNullSafe(F.col("r_conv")) & (F.col("c_call") == F.col("r_call")), "full",
    ).select(
        F.coalesce("c_conv", "r_conv").alias("c_conv"), F.coalesce("c_call", "r_call").alias("c_call"), "call", "result")
    own = F.struct("seq", "msg_id")
    status = (
        F.when(F.col("kind") == "call", F.when(
            F.col("call").isNotNull() & ~own.eqNullSafe(F.col("call")), "repeated").when(
            F.col("result").isNull(), "unanswered").otherwise("linked"))
        .when(F.col("kind") == "result", F.when(F.col("call").isNull(), "orphan").when(
            ~own.eqNullSafe(F.col("result")), "repeated").otherwise("linked"))
        .otherwise("plain")
    )
    return messages.join(both, key[0] & key[1], "left").withColumn("status", status).withColumn(
        "parent", F.when(F.col("kind") == "result", F.col("call")["msg_id"]).otherwise(F.col("after"))
    ).drop("c_conv", "c_call", "call", "result")


def _depths(messages):
    """(``conv_id``, ``msg_id``, ``depth``) of the first message of each id; the depth is NULL on and below cycles."""
    nodes = messages.groupBy("conv_id", "msg_id").agg(
        F.min(F.struct("seq", "parent"))["parent"].alias("parent"))
    ids = nodes.select(F.col("conv_id").alias("p_conv"), F.col("msg_id").alias("p_id"))
    steps = nodes.join(
        ids, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("parent") == F.col("p_id")), "left"
    ).select("conv_id", "msg_id", F.col("p_id").alias("up"), F.col("p_id").isNotNull().cast("long").alias("depth"))
    steps = staged(steps, "depths")
    done, active = [steps.where("up IS NULL")], steps.where("up IS NOT NULL")
    longest = steps.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(longest.bit_length()):
        every = active
        for part in done:
            every = every.unionByName(part)
        far = every.select(F.col("conv_id").alias("f_conv"), F.col("msg_id").alias("f_id"),
                           F.col("up").alias("f_up"), F.col("depth").alias("f_depth"))
        steps = staged(active.join(
            far, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("up") == F.col("f_id")), "left"
        ).select("conv_id", "msg_id", F.col("f_up").alias("up"),
                 (F.col("depth") + F.coalesce("f_depth", F.lit(0))).alias("depth")), "depths")
        done.append(steps.where("up IS NULL"))
        active = steps.where("up IS NOT NULL")
        if active.isEmpty():
            break
    for part in done:  # what is still active lies on or below a cycle
        active = active.unionByName(part)
    return active.select("conv_id", "msg_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _without_id(messages):
    """The messages without id, which no other can name, with the columns of linked ones."""
    status = F.when(F.col("kind") == "call", "unanswered").when(F.col("kind") == "result", "orphan").otherwise("plain")
    return messages.where("msg_id IS NULL").withColumn("status", status).withColumn(
        "parent", F.lit(None).cast("string")).withColumn("depth", F.lit(0).cast("long"))


def formatted(messages, schemas=SCHEMAS):
    """``conv_id``, ``msg_id``, ``depth``, ``seq``, ``status``, ``valid``, ``errors`` and ``json`` per message.

    ``messages`` has ``conv_id``, ``msg_id``, ``seq``, ``kind``, ``role``, ``call_id``, ``tool``,
    ``arguments`` (JSON text), ``content`` and ``after`` (an id). ``valid`` is NULL for all but calls.
    """
    messages = messages.select(
        "conv_id", "msg_id", "seq", "kind", "role", "call_id", "tool", "arguments", "content", "after")
    rows = staged(_statuses(messages.where("msg_id IS NOT NULL")), "linked")
    depths = _depths(rows).select(F.col("conv_id").alias("d_conv"), F.col("msg_id").alias("d_id"), "depth")
    rows = rows.join(
        depths, F.col("conv_id").eqNullSafe(F.col("d_conv")) & (F.col("parent") == F.col("d_id")), "left"
    ).withColumn("depth", F.when(F.col("d_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("depth") + 1)).drop(
        "d_conv", "d_id").withColumn("status", F.when(F.col("depth").isNull(), "cycle").otherwise(F.col("status")))
    rows = rows.unionByName(_without_id(messages).select(*rows.columns))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = ("conv_id", "msg_id", "depth", "seq", "status")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            texts, valid, errors = [], [], []
            for kind, role, call, tool, arguments, content in zip(*(
                    columns[c].to_pylist() for c in ("kind", "role", "call_id", "tool", "arguments", "content"))):
                if kind == "call":
                    value, wrong = checked_arguments(arguments, schemas.get(tool))
                    texts.append(canonical({"role": role, "content": content, "tool_call": {
                        "id": call, "name": tool, "arguments": value}}))
                    valid.append(not wrong)
                    errors.append("; ".join(wrong))
                else:
                    texts.append(canonical({"role": role, "content": content} | (
                        {"tool_call_id": call} if kind == "result" else {})))
                    valid.append(None)
                    errors.append("")
            yield pa.RecordBatch.from_arrays(
                [*(columns[c] for c in kept), pa.array(valid, pa.bool_()), pa.array(errors, pa.string()),
                 pa.array(texts, pa.string())], [*kept, "valid", "errors", "json"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", valid boolean, errors string, json string")


def as_messages(conversations):
    """Conversations as tool messages: a user turn calls the tool ``reply``, and the assistant's next turn is its
    result. A turn hangs on the one before."""
    turn = F.col("turn")
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    call = F.when(F.col("role") == "user", turn).when(F.col("role") == "assistant", turn - 1)
    return conversations.select(
        "conv_id", turn.cast("string").alias("msg_id"), turn.alias("seq"), kind.alias("kind"), "role",
        F.concat(F.lit("call-"), call.cast("string")).alias("call_id"),
        F.when(kind == "call", "reply").alias("tool"),
        F.when(kind == "call", F.to_json(F.struct("turn", "text"))).alias("arguments"),
        F.when(kind != "call", F.col("text")).alias("content"),
        (turn - 1).cast("string").alias("after"),
    )


def op7_tool_calls(spark, folder):
    """Every turn of ``conversations`` as a linked, ordered and serialised message."""
    return formatted(as_messages(load(spark, folder, "conversations")))
