"""Chat formatting by linking tool calls, in DataFrame and SQL functions only.

Calls and results meet in a hash join on conversation and call id. Declared
arguments may name other calls ("$id", alone or in a list); such calls come
later. Which arguments do is a parameter; names are read from the parsed JSON,
so a "$" in any other text means nothing. Chains of calls that name
one call each are followed by pointer jumping, in rounds as the logarithm of
their length; each further round gives a level to calls that name several, until
none is new. What is left has no level: it names a missing call or one that
waits for a missing one, or it is in or behind a circle. Arguments are checked
against the tools' schemas, and calls and results are serialised as canonical JSON (keys in order, no blanks). Each
call is a row with its place (level, turn), so a conversation of any length is
never gathered.

Defined results: of calls with one id the first turn counts, further ones are
'duplicate' and take no result; a result without a call is 'orphan', a call
without a result 'unanswered'; of results with one id the first counts, further
ones are rows of their own, 'answered again'; arguments that are no JSON object are 'not an
object'; null ids link with nothing, and their rows are spread over tasks; a
text of any length is one string; empty tables yield no rows. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.store import written

def _needs(references: dict[str, list[str]] | None = None) -> Column:
    """The calls that a call's arguments name: those of its tool's ``references``, or all top-level ones."""
    fields = F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string, variant>")

    def named(value: Column) -> Column:
        some = F.coalesce(F.try_variant_get(value, "$", "array<string>"), F.array(F.try_variant_get(value, "$", "string")))
        some = F.when(F.schema_of_variant(value).rlike("STRING"), some).otherwise(F.array().cast("array<string>"))
        return F.transform(F.filter(some, lambda x: x.rlike(r"(?s)^\$.+$")), lambda x: F.substr(x, F.lit(2)))

    if references is None:
        every = F.flatten(F.transform(F.map_values(fields), named))
    else:
        every = F.array().cast("array<string>")
        for tool, names in sorted(references.items()):
            if names:
                every = F.when(F.col("name") == tool, F.flatten(F.array(*(named(F.element_at(fields, k)) for k in names)))).otherwise(every)
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def _followed(nodes: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, steps): calls that name one call, each with the next call along them that names none or several.

    Pointer jumping; calls in circles and above missing ones are left out.
    """
    ends = nodes.where(F.size("needs") != 1).select("conv_id", F.col("call_id").alias("root"), F.lit(False).alias("end"))
    one = nodes.where(F.size("needs") == 1).select("conv_id", "call_id", F.col("needs")[0].alias("root"), F.lit(1).cast("long").alias("steps"))
    state = written(one.join(ends, ["conv_id", "root"], "left").select("conv_id", "call_id", "root", "steps", F.col("end").isNull().alias("open")))
    left, before = state.where("open").count(), None
    while left and left != before:  # each round settles or drops a call, unless all that are left lead to circles
        ahead = state.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("on"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(ahead, ["conv_id", "root"]).select("conv_id", "call_id", F.col("on").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        state = written(state.where("not open").unionByName(moved))
        left, before = state.where("open").count(), left
    return state.where("not open").drop("open")


def _levels(calls: DataFrame, references: dict[str, list[str]] | None = None) -> DataFrame:
    """(conv_id, call_id, level); calls in or behind circles, and those that wait for a missing one, are left out."""
    return _leveled(calls.select("conv_id", "call_id", _needs(references).alias("needs")))


def _without_missing(nodes: DataFrame) -> DataFrame:
    """``nodes`` whose needs are in the table; empty if all are."""
    edges = nodes.where(F.size("needs") > 0).select("conv_id", "call_id", F.explode("needs").alias("need"))
    lost = written(edges.join(nodes.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"))
    if lost.isEmpty():
        return nodes.limit(0)
    gone = lost.groupBy("conv_id", "call_id").agg(F.collect_set("need").alias("gone"))
    return nodes.join(gone, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(F.col("gone").isNull(), F.col("needs")).otherwise(F.array_except("needs", "gone")).alias("needs"))


def _leveled(nodes: DataFrame) -> DataFrame:
    done = nodes.where(F.size("needs") == 0).select("conv_id", "call_id", F.lit(0).cast("long").alias("level"))
    if nodes.where(F.size("needs") > 0).isEmpty():
        return done
    nodes = written(nodes)
    done = nodes.where(F.size("needs") == 0).select("conv_id", "call_id", F.lit(0).cast("long").alias("level"))
    along = _followed(nodes)
    several = nodes.where(F.size("needs") > 1)
    if not several.isEmpty():
        ends = nodes.where(F.size("needs") != 1).select("conv_id", F.col("call_id").alias("need"), F.col("call_id").alias("root"), F.lit(0).cast("long").alias("steps"))
        edges = several.select("conv_id", "call_id", F.size("needs").alias("n"), F.explode("needs").alias("need"))
        edges = written(edges.join(ends.unionByName(along.withColumnRenamed("call_id", "need")), ["conv_id", "need"]).drop("need"))
        rounds = 0
        while True:
            have = done.withColumnRenamed("call_id", "root")
            ready = edges.join(have, ["conv_id", "root"]).groupBy("conv_id", "call_id", "n").agg(F.count("*").alias("met"), (F.max(F.col("level") + F.col("steps")) + 1).alias("level")).where("met = n")
            fresh = written(ready.join(done, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", "level"))
            if fresh.isEmpty():
                break
            rounds += 1
            done = done.unionByName(fresh)
            done = written(done) if rounds % 16 == 0 else done  # keeps the plan short
    on = done.withColumnRenamed("call_id", "root")
    return done.unionByName(along.join(on, ["conv_id", "root"]).select("conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, str]], references: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per call or orphan result: place, problems, canonical JSON of both.

    ``calls`` has (conv_id, call_id, turn, name, arguments), ``results`` (conv_id,
    call_id, turn, content), ``schemas`` maps a tool's name to its arguments and
    their types ('string', 'integer', 'number', 'boolean'); all are required.
    ``references`` maps a tool's name to the arguments that may name calls; by
    default every argument may.
    """
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls, results = calls.select("conv_id", "call_id", "turn", "name", "arguments"), results.select("conv_id", "call_id", "turn", "content")
    first = Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "arguments")
    ranked = written(calls.where(known).withColumn("nth", F.row_number().over(first)))
    linked = results.where(known).withColumn("answer", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("turn", "content")))
    answers = linked.groupBy("conv_id", "call_id").agg(F.min_by("content", "answer").alias("content"), F.min_by("turn", "answer").alias("answer_turn"), F.count("*").alias("answers"))
    nodes = written(ranked.where("nth = 1").select("conv_id", "call_id", _needs(references).alias("needs")))
    levels = _leveled(nodes).withColumn("late", F.lit(False))
    found = _without_missing(nodes)
    if not found.isEmpty():
        late = _leveled(written(found)).join(levels, ["conv_id", "call_id"], "left_anti")
        levels = levels.unionByName(late.select("conv_id", "call_id", F.lit(None).cast("long").alias("level"), F.lit(True).alias("late")))
    met = ranked.withColumn("call", F.lit(True)).join(answers.withColumn("nth", F.lit(1)), ["conv_id", "call_id", "nth"], "full").join(levels.withColumn("nth", F.lit(1)), ["conv_id", "call_id", "nth"], "left")
    # rows without an id link with nothing, so they need no join
    names = F.size(_needs(references)) > 0
    alone = calls.where(~known).select("*", F.when(~names, F.lit(0)).cast("long").alias("level"), names.alias("late"), F.lit(1).alias("nth"), F.lit(True).alias("call"))
    lone = results.where(~known).select("conv_id", "call_id", "content", F.col("turn").alias("answer_turn"), F.lit(1).cast("long").alias("answers"), F.lit(1).alias("nth"))
    one = met.unionByName(alone, allowMissingColumns=True).unionByName(lone, allowMissingColumns=True).withColumn("level", F.col("level").cast("int"))
    parsed = F.try_parse_json("arguments")
    kind = F.schema_of_variant(parsed)
    types = F.try_variant_get(parsed, "$", "map<string, variant>")
    good = {"string": r"STRING", "integer": r"BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL.*", "boolean": r"BOOLEAN"}
    wrong = F.lit(None).cast("string")
    for tool, fields in sorted(schemas.items()):
        checks = [F.when(~F.coalesce(F.schema_of_variant(F.element_at(types, k)).rlike(f"^({good[t]})$"), F.lit(False)), F.lit(k)) for k, t in sorted(fields.items())]
        extra = F.array_except(F.map_keys(types), F.array(*(F.lit(k) for k in fields))) if fields else F.map_keys(types)
        wrong = F.when(F.col("name") == tool, F.concat_ws(",", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra)).otherwise(wrong)
    is_call = F.col("call").isNotNull()
    problem = (
        F.when(~is_call, "orphan").when(F.col("nth") > 1, "duplicate").when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "not an object")
        .when(wrong.isNull(), "unknown tool").when(wrong != "", F.concat(F.lit("arguments: "), wrong))
        .when(F.col("late"), "names a missing call").when(F.col("level").isNull(), "circle").when(F.col("content").isNull() & F.col("answers").isNull(), "unanswered")
        .when(F.col("answer_turn") < F.col("turn"), "answered before").when(F.col("answers") > 1, "answered twice")
    )
    canonical = F.coalesce(F.to_json(parsed), F.to_json(F.struct(F.col("arguments").alias("text"))))
    call_json = F.when(is_call, F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), _string("call_id"), F.lit(',"name":'), _string("name"), F.lit(',"role":"call"}')))
    result_json = F.when(F.col("answers").isNotNull(), F.concat(F.lit('{"content":'), _string("content"), F.lit(',"id":'), _string("call_id"), F.lit(',"role":"result"}')))
    rows = one.select("conv_id", "call_id", "level", "turn", "answer_turn", "name", F.col("answers").isNotNull().alias("linked"), problem.alias("problem"), call_json.alias("call_json"), result_json.alias("result_json"))
    answer_json = F.concat(F.lit('{"content":'), _string("content"), F.lit(',"id":'), _string("call_id"), F.lit(',"role":"result"}'))
    again = linked.where("answer > 1").select("conv_id", "call_id", _null("int", "level"), _null("long", "turn"), F.col("turn").alias("answer_turn"), _null("string", "name"), F.lit(True).alias("linked"), F.lit("answered again").alias("problem"), _null("string", "call_json"), answer_json.alias("result_json"))
    return rows.unionByName(again)


def _null(kind: str, name: str):
    return F.lit(None).cast(kind).alias(name)


def _string(column: str):
    """A string as JSON."""
    return F.when(F.col(column).isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(F.col(column).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1))


def _ident(turn):
    """Id of the call that a turn stands for; null where the conversation is."""
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def _reply_calls(asked: DataFrame) -> DataFrame:
    """Calls of users' turns with the turn that each names (``after``, null for none)."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    after = F.coalesce(F.concat(F.lit("$"), _ident(F.col("after"))), F.lit(""))
    arguments = F.to_json(F.struct(words.alias("words"), F.coalesce("text", F.lit("")).alias("prompt"), after.alias("after")))
    return asked.select("conv_id", _ident(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"))


def _reply_results(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'assistant'").select("conv_id", _ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))


def conversations_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations stand for: a user's turn asks, the assistant's next turn answers.

    A conversation's later questions name its first one. Turns of other roles are left out; ``format_turns`` has every turn.
    """
    asked = turns.where("role = 'user'")
    first = asked.groupBy("conv_id").agg(F.min("turn").alias("first"))
    named = asked.join(first, "conv_id", "left").withColumn("after", F.when(F.col("turn") > F.col("first"), F.col("first")))
    return _reply_calls(named), _reply_results(turns)


def _turns_before(asked: DataFrame, width: int = 1024) -> DataFrame:
    """(conv_id, turn, after): each turn with the one before it. Parts of ``width`` turns are ordered by themselves, so no task orders a long conversation."""
    parts = asked.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.floor(F.col("turn") / width).alias("part")).distinct()
    ends = parts.groupBy("conv_id", "part").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "part", F.lag("end").over(Window.partitionBy("conv_id").orderBy("part")).alias("end"))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "part").orderBy("turn"))
    return parts.withColumn("after", inside).join(ends, ["conv_id", "part"]).select("conv_id", "turn", F.coalesce("after", "end").alias("after"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Every turn of plain conversations: users' turns as calls that name the user's turn before, assistants' as results.

    Turns of any other role, or of none, are rows with the role as name and the message as JSON.
    """
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    asked = asked.join(_turns_before(asked), ["conv_id", "turn"], "left")
    rows = link_tool_calls(_reply_calls(asked), _reply_results(turns), CONVERSATION_TOOLS, CONVERSATION_REFERENCES)
    message = F.concat(F.lit('{"content":'), _string("text"), F.lit(',"role":'), _string("role"), F.lit("}"))
    others = turns.where("role is null or role not in ('user', 'assistant')")
    return rows.unionByName(others.select("conv_id", _null("string", "call_id"), _null("int", "level"), "turn", _null("long", "answer_turn"), F.col("role").alias("name"), F.lit(False).alias("linked"), _null("string", "problem"), message.alias("call_json"), _null("string", "result_json")))


#: Only this argument names calls: a prompt may hold any text.
CONVERSATION_REFERENCES = {"reply": ["after"]}
CONVERSATION_TOOLS = {"reply": {"after": "string", "prompt": "string", "words": "integer"}}
