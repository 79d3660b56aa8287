"""Tool calls and their results: linked, ordered, validated and written as canonical JSON.

Built-in DataFrame functions only.  Nothing is gathered per conversation: every
message is a row with its place, so one conversation may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import shared_dir, write_table

CALL = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
#: Of a schema: parameter -> (JSON type, required).
Schema = dict[str, tuple[str, bool]]
# JSON types and the type names that a parsed value reports.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in messages (conv_id, turn, role, text).

    An assistant's text ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``
    makes calls, a tool's text ``{"tool_call_id", "content"}`` a result.  Other texts,
    nulls and broken JSON make neither.
    """
    v = messages.select("conv_id", "turn", "role", F.try_parse_json("text").alias("v"))
    listed = v.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')")).alias("c"))
    get = lambda c, path, kind: F.expr(f"try_variant_get({c}, '{path}', '{kind}')")
    calls = listed.select("conv_id", "turn", get("c", "$.id", "string").alias("call_id"), get("c", "$.name", "string").alias("name"), F.to_json(get("c", "$.arguments", "variant")).alias("arguments"), get("c", "$.depends_on", "array<string>").alias("depends_on"))
    results = v.where("role = 'tool'").select("conv_id", "turn", get("v", "$.tool_call_id", "string").alias("call_id"), get("v", "$.content", "string").alias("content"))
    return calls.where("call_id IS NOT NULL"), results.where("call_id IS NOT NULL")


def problems(name: Column, parsed: str, schemas: dict[str, Schema]) -> Column:
    """Array of what is wrong with arguments: unknown tool, no object, missing, unexpected or ill-typed parameters."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    out = F.array(F.lit("unknown tool"))
    for tool in sorted(schemas, reverse=True):
        checks = []
        for p, (kind, required) in sorted(schemas[tool].items()):
            path = quoted(f"$['{p}']" if "'" not in p else f'$["{p}"]')
            value = f"try_variant_get({parsed}, {path}, 'variant')"
            there = F.expr(f"{value} IS NOT NULL")
            right = F.expr(f"schema_of_variant({value})").rlike(f"^({TYPES[kind]})$")
            checks.append(F.when(there & ~right, F.lit(f"{p}: not {kind}")).when(F.lit(required) & ~there, F.lit(f"{p}: missing")))
        extra = F.array_except(F.json_object_keys(F.expr(f"to_json({parsed})")), F.array(*[F.lit(p) for p in schemas[tool]]).cast("array<string>"))
        found = F.concat(F.array_compact(F.array(*checks)).cast("array<string>"), F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(": unexpected"))))
        is_object = F.expr(f"coalesce(schema_of_variant({parsed}) LIKE 'OBJECT%', false)")
        out = F.when(name == tool, F.when(is_object, found).otherwise(F.array(F.lit("arguments: not an object")))).otherwise(out)
    return out


def stages(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, stage): rows in order of (stage, turn, call_id) never precede what they depend on.

    A conversation whose calls depend on earlier turns only is in order as it is: stage 0.
    In others each call's stage is 1 plus the largest stage among its dependencies.
    Chains of calls with one dependency are followed by pointer doubling, so a chain
    takes rounds by the logarithm of its length; calls with several dependencies are
    placed level by level, over the conversations concerned alone.  Calls on a cycle, or
    behind one, have a null stage.  Dependencies on unknown calls do not count.
    """
    needs = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("on")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = needs.join(known.hint("shuffle_hash"), ["conv_id", "on"])
    late = edges.where("on_turn >= turn").select("conv_id").distinct()
    in_order = calls.join(late, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).cast("long").alias("stage"))
    if late.isEmpty():
        return in_order
    key, folder = ["conv_id", "call_id"], shared_dir(calls.sparkSession)
    nodes = write_table(calls.join(late, "conv_id", "left_semi").select(*key), folder, "nodes")
    edges = write_table(edges.join(late, "conv_id", "left_semi").select(*key, "on"), folder, "edges")
    degree = edges.groupBy(*key).agg(F.count("*").alias("needs"), F.first("on").alias("on"))
    one = degree.where("needs = 1").select(*key, F.col("on").alias("head"), F.lit(1).cast("long").alias("steps"))
    one = write_table(one, folder, "chains_0")
    length, rounds = one.count(), 0
    while 1 << rounds < 2 * length:  # then every pointer has passed all chains that end
        rounds += 1
        further = one.select("conv_id", F.col("call_id").alias("head"), F.col("head").alias("_head"), F.col("steps").alias("_steps"))
        jumped = one.join(further.hint("shuffle_hash"), ["conv_id", "head"], "left")
        one = jumped.select(*key, F.coalesce("_head", "head").alias("head"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_head").isNotNull().alias("moved"))
        one = write_table(one, folder, f"chains_{rounds}")
        moved = not one.where("moved").isEmpty()
        one = one.drop("moved")
        if not moved:
            break
    # Dependencies of calls with several, on the heads of chains: calls with none or several themselves.
    heads = one.select("conv_id", F.col("call_id").alias("on"), "head", "steps")
    several = edges.join(one.select(*key), key, "left_anti").join(heads.hint("shuffle_hash"), ["conv_id", "on"], "left")
    waits = write_table(several.select(*key, F.coalesce("head", "on").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps")), folder, "waits_0")
    free = nodes.join(degree.select(*key), key, "left_anti").withColumn("stage", F.lit(1).cast("long"))
    placed, step = write_table(free, folder, "placed_0"), 0
    last = placed
    while not waits.isEmpty():
        step += 1
        ready = last.select("conv_id", F.col("call_id").alias("head"), "stage")
        known = waits.join(ready.hint("shuffle_hash"), ["conv_id", "head"], "left")
        known = known.select(*key, "head", "steps", F.coalesce(F.col("stage") + F.col("steps"), F.col("at") if "at" in waits.columns else F.lit(None).cast("long")).alias("at"))
        known = write_table(known, folder, f"waits_{step}")
        done = known.groupBy(*key).agg(F.count(F.when(F.col("at").isNull(), 1)).alias("open"), (F.max("at") + 1).alias("stage")).where("open = 0")
        last = write_table(done.select(*key, "stage"), folder, f"placed_{step}")
        if last.isEmpty():
            break
        placed = placed.unionByName(last)
        waits = known.join(last.select(*key), key, "left_anti")
    ends = placed.select("conv_id", F.col("call_id").alias("head"), F.col("stage").alias("_stage"))
    chained = one.join(ends.hint("shuffle_hash"), ["conv_id", "head"]).select(*key, (F.col("_stage") + F.col("steps")).alias("stage"))
    placed = placed.unionByName(chained)
    return in_order.unionByName(nodes.join(placed.hint("shuffle_hash"), key, "left").select(*key, "stage"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per call, per result, and per repeat of either: conv_id, turn, call_id, kind, stage, errors, line.

    ``kind`` is call, result, orphan (a result without a call) or repeat (a later call or
    result of an identifier that has one; ties by content).  A result has its call's
    stage.  ``errors`` lists what is wrong (an empty list: nothing): schema problems, an
    unknown dependency, a cycle, a missing or an early result.  ``line`` is JSON with
    keys in order, no spaces and no nulls; object arguments have their keys in order too.
    Null conversations or identifiers link with nothing.  Empty tables give an empty result; columns
    besides those named are left out.  First rows are found by aggregation before the
    hash join, so no identifier or conversation needs one task.
    """
    c, r = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on"), results.select("conv_id", "turn", "call_id", "content")
    key, named = ["conv_id", "call_id"], "conv_id IS NOT NULL AND call_id IS NOT NULL"
    pick = lambda df, *cols: df.groupBy(*key).agg(F.min(F.struct("turn", *cols)).alias("x"), F.count("*").alias("rows"))
    first_c = pick(c.where(named), "name", "arguments", "depends_on").select(*key, "x.*", F.col("rows").alias("call_rows"))
    first_r = pick(r.where(named), "content").select(*key, F.col("x.turn").alias("result_turn"), F.col("x.content").alias("content"), F.col("rows").alias("result_rows"))
    placed = first_c.join(stages(first_c).hint("shuffle_hash"), key)
    # The number of dependencies that are not known.
    on = first_c.select(*key, F.explode(F.array_distinct("depends_on")).alias("on"))
    lost = on.join(first_c.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_anti").groupBy(*key).agg(F.count("*").alias("lost"))
    both = placed.join(lost.hint("shuffle_hash"), key, "left").join(first_r.hint("shuffle_hash"), key, "full_outer")
    parsed = "try_parse_json(arguments)"
    wrong = F.concat(
        problems(F.col("name"), parsed, schemas),
        F.array_compact(F.array(F.when(F.col("lost") > 0, F.lit("depends_on: unknown call")), F.when(F.col("stage").isNull(), F.lit("depends_on: cycle")), F.when(F.col("result_rows").isNull(), F.lit("result: missing")), F.when(F.col("result_turn") <= F.col("turn"), F.lit("result: before its call")))),
    )
    argument = F.coalesce(F.expr(f"to_json({parsed})"), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    text = lambda c: F.regexp_replace(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r'^\{"x":|\}$', "")
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    call_line = F.concat(F.lit("{"), F.concat_ws(",", pair("arguments", argument), pair("call_id", text(F.col("call_id"))), pair("kind", F.lit('"call"')), pair("name", text(F.col("name")))), F.lit("}"))
    result_line = lambda kind: F.concat(F.lit("{"), F.concat_ws(",", pair("call_id", text(F.col("call_id"))), pair("content", text(F.col("content"))), pair("kind", F.lit(f'"{kind}"'))), F.lit("}"))
    none = F.array().cast("array<string>")
    row = lambda turn, kind, stage, errors, line: F.struct(turn.alias("turn"), F.lit(kind).alias("kind"), stage.alias("stage"), errors.alias("errors"), line.alias("line"))
    null_stage = F.lit(None).cast("long")
    is_call, is_result = F.col("call_rows").isNotNull(), F.col("result_rows").isNotNull()
    entries = F.array(
        F.when(is_call, row(F.col("turn"), "call", F.col("stage"), wrong, call_line)),
        F.when(is_call & is_result, row(F.col("result_turn"), "result", F.col("stage"), none, result_line("result"))),
        F.when(~is_call & is_result, row(F.col("result_turn"), "orphan", null_stage, none, result_line("orphan"))),
    )
    out = both.select(*key, F.explode(F.array_compact(entries)).alias("e")).select("conv_id", "e.turn", "call_id", "e.kind", "e.stage", "e.errors", "e.line")

    def repeats(df: DataFrame, cols: list[str], what: str) -> DataFrame:
        """Rows beyond the first of their identifier; equal rows are counted, then listed again."""
        same = df.groupBy("conv_id", "call_id", "turn", *cols).agg(F.count("*").alias("times"))
        head = pick(df, *cols).where("rows > 1").select(F.col("conv_id").alias("_v"), F.col("call_id").alias("_c"), "x")
        is_first = F.col("x.turn").eqNullSafe(F.col("turn"))
        for k in cols:
            is_first = is_first & F.col(f"x.{k}").eqNullSafe(F.col(k))
        extra = same.join(head, (F.col("conv_id") == F.col("_v")) & (F.col("call_id") == F.col("_c"))).withColumn("times", F.col("times") - F.when(is_first, 1).otherwise(0)).where("times > 0")
        again = extra.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        return again.select("conv_id", "turn", "call_id", F.lit("repeat").alias("kind"), null_stage.alias("stage"), F.array(F.lit(f"{what}: repeated")).alias("errors"), (call_line if what == "call" else result_line("repeat")).alias("line"))

    unnamed = r.where(f"NOT ({named})").select("conv_id", "turn", "call_id", F.lit("orphan").alias("kind"), null_stage.alias("stage"), F.array(F.lit("identifier: missing")).alias("errors"), result_line("orphan").alias("line"))
    nameless = c.where(f"NOT ({named})").select("conv_id", "turn", "call_id", F.lit("call").alias("kind"), null_stage.alias("stage"), F.array(F.lit("identifier: missing")).alias("errors"), call_line.alias("line"))
    rest = repeats(c.where(named), ["name", "arguments", "depends_on"], "call").unionByName(repeats(r.where(named), ["content"], "result"))
    return out.unionByName(rest).unionByName(unnamed).unionByName(nameless)


REPLY_SCHEMA: dict[str, Schema] = {"reply": {"chars": ("integer", True), "prompt": ("string", True)}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain dialogue as calls and results: a user or system turn calls ``reply``, the assistant turn after it is the result.

    Each call depends on the one two turns before.
    """
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    calls = t.where("role IS DISTINCT FROM 'assistant'").select("conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), F.length("text").alias("chars"))).alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    return calls, t.where("role = 'assistant'").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))


def turns_as_messages(conversations: DataFrame) -> DataFrame:
    """Plain dialogue as tool-call messages (conv_id, turn, role, text), for parse_messages().

    A user or system turn is a message with one call of ``reply`` on its text, the
    assistant turn after it the tool's message with the result.  What can be wrong with real
    calls is there by rule, from the number n of characters: another tool (n % 13 = 0),
    a number as a string (n % 7 = 0), a parameter left out (n % 5 = 0) or too many
    (n % 11 = 0).  A call depends on the one two turns before; in conversations with
    conv_id % 4 = 1 on the one two turns later, and with conv_id % 4 = 2 the first one
    on the second as well, which makes a cycle.
    """
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":|\}$', "")
    name = lambda shift: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + shift).cast("string"))
    many = lambda divisor: F.col("n") % divisor == 0
    count = F.col("n").cast("string")
    parameters = F.concat_ws(
        ",",
        F.when(~many(5), F.concat(F.lit('"prompt":'), quoted)),
        F.concat(F.lit('"chars":'), F.when(many(7), F.concat(F.lit('"'), count, F.lit('"'))).otherwise(count)),
        F.when(many(11), F.lit('"extra":true')),
    )
    kind = F.pmod("conv_id", F.lit(4))
    later = (kind == 1) | ((kind == 2) & (F.col("turn") == 0))
    on = F.when(later, name(2)).when(F.col("turn") >= 2, name(-2))
    call = F.concat(
        F.lit('{"tool_calls":[{"id":"'), name(0), F.lit('","name":"'), F.when(many(13), F.lit("search")).otherwise(F.lit("reply")),
        F.lit('","arguments":{'), parameters, F.lit('},"depends_on":['), F.coalesce(F.concat(F.lit('"'), on, F.lit('"')), F.lit("")), F.lit("]}]}"),
    )
    result = F.concat(F.lit('{"tool_call_id":"'), name(-1), F.lit('","content":'), quoted, F.lit("}"))
    answers = F.col("role").eqNullSafe("assistant")
    return t.select("conv_id", "turn", F.when(answers, F.lit("tool")).otherwise(F.lit("assistant")).alias("role"), F.when(answers, result).otherwise(call).alias("text"))
