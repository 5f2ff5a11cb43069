"""Every turn has a row, and calls have levels at any depth."""

import collections

from geoloom.llm import chat_format, queries

CALLS = "conv_id long, call_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_levels_have_no_bound(spark):
    calls = [(1, f"c{k}", k, "f", f'{{"x":"$c{k - 1}"}}' if k else '{"x":""}') for k in range(100)]
    calls += [(3, "a", 0, "f", '{"x":"$b"}'), (3, "b", 1, "f", '{"x":"$a"}'), (3, "c", 2, "f", '{"x":"$a"}'), (3, "d", 3, "f", '{"x":"$gone"}'), (3, "e", 4, "f", '{"x":"$d"}'), (3, "s", 5, "f", '{"x":"$s"}')]
    calls += [(4, "p", 0, "f", '{"x":""}'), (4, "q", 1, "f", '{"x":"$p"}'), (4, "r", 2, "f", '{"x":"$q"}'), (4, "t", 3, "f", '{"x":["$p","$r"]}'), (4, "u", 4, "f", '{"x":"$t"}'), (4, "v", 5, "f", '{"x":["$u","$p"]}'), (4, "w", 6, "f", '{"x":["$u","$gone"]}')]
    got = {(r.conv_id, r.call_id): r.level for r in chat_format._levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {(1, f"c{k}"): k for k in range(100)} | {(4, c): n for n, c in enumerate("pqrtuv")}


def test_deep_chain_is_no_circle(spark):
    calls = spark.createDataFrame([(1, f"c{k}", k, "f", f'{{"x":"{"$c" + str(k - 1) if k else ""}"}}') for k in range(80)], CALLS)
    rows = chat_format.link_tool_calls(calls, spark.createDataFrame([], RESULTS), {"f": {"x": "string"}}).collect()
    assert {(r.level, r.problem) for r in rows} == {(k, "unanswered") for k in range(80)}


def test_every_turn_has_a_row(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 2, "assistant", "c"), (1, 3, "tool", "t"), (1, 4, "user", "d"), (1, 5000, "user", "e"), (None, 1, "user", "f"), (None, 3, "user", "f2"), (None, 2, "assistant", "g"), (None, 2, "assistant", "h"), (2, 0, None, 'x"y'), (2, 1, "user", "i"), (2, 1, "user", "j")]
    rows = chat_format.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    seen = collections.Counter()
    for r in rows:
        seen.update([(r.conv_id, r.turn)] if r.call_json or r.turn is not None else [])
        seen.update([(r.conv_id, r.answer_turn)] if r.answer_turn is not None else [])
    assert seen == collections.Counter((c, t) for c, t, _, _ in turns)
    assert {(r.conv_id, r.turn): r.level for r in rows if r.conv_id == 1 and r.name == "reply"} == {(1, 1): 0, (1, 4): 1, (1, 5000): 2}
    assert {(r.name, r.call_json) for r in rows if r.turn is not None and r.name != "reply"} == {("system", '{"content":"be kind","role":"system"}'), ("tool", '{"content":"t","role":"tool"}'), (None, '{"content":"x\\"y","role":null}')}
    assert sorted(r.problem for r in rows if r.conv_id is None) == ["orphan", "orphan", "unanswered", "unanswered"]


def test_null_conversations_keep_their_questions(spark):
    turns = spark.createDataFrame([(None, 1, "user", "f"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat_format.conversations_as_calls(turns)[0].count() == 2


def test_whole_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = queries.op5_chat_formatting_whole(spark, sf).collect()
    assert sum((r.turn is not None) + (r.answer_turn is not None) for r in rows) == turns.count()
