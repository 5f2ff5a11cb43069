"""Calls are named in declared arguments only; missing calls and circles have labels of their own."""

from geoloom.llm import chat_format

CALLS = "conv_id long, call_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"
TURNS = "conv_id long, turn long, role string, text string"


def problems(spark, calls, results=(), **more):
    rows = chat_format.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), RESULTS), {"f": {"x": "string", "y": "string"}}, **more)
    return {(r.conv_id, r.call_id): (r.level, r.problem) for r in rows.collect()}


def test_prompts_with_signs_are_no_names(spark):
    turns = [(1, 0, "user", "$5 for lunch?"), (1, 1, "assistant", "no"), (1, 2, "user", 'say "$x" and "$1:2"'), (1, 4, "user", "$1:4")]
    rows = chat_format.format_turns(spark.createDataFrame(turns, TURNS)).collect()
    assert {(r.turn, r.level, r.problem) for r in rows} == {(0, 0, None), (2, 1, "unanswered"), (4, 2, "unanswered")}


def test_only_declared_arguments_name_calls(spark):
    calls = [(1, "a", 0, "f", '{"x":"$b","y":"$a"}'), (1, "b", 1, "f", '{"x":"","y":"$9"}')]
    assert problems(spark, calls, references={"f": ["x"]}) == {(1, "a"): (1, "unanswered"), (1, "b"): (0, "unanswered")}


def test_missing_calls_and_circles(spark):
    calls = [(1, "a", 0, "f", '{"x":"$gone","y":""}'), (1, "b", 1, "f", '{"x":"$a","y":""}'), (1, "c", 2, "f", '{"x":"$d","y":""}'), (1, "d", 3, "f", '{"x":"$c","y":"$gone"}'), (1, "e", 4, "f", '{"x":"$c","y":""}'), (2, "a", 0, "f", '{"x":"$","y":"$ b"}'), (2, " b", 0, "f", '{"x":"","y":""}')]
    assert problems(spark, calls) == {
        (1, "a"): (None, "names a missing call"), (1, "b"): (None, "names a missing call"), (1, "c"): (None, "circle"), (1, "d"): (None, "circle"), (1, "e"): (None, "circle"),
        (2, "a"): (1, "unanswered"), (2, " b"): (0, "unanswered"),
    }


def test_rows_without_ids_and_empty_tables(spark):
    calls = [(None, "a", k, "f", '{"x":"","y":""}') for k in range(3)] + [(1, None, 0, "f", '{"x":"$a","y":""}')]
    rows = chat_format.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(None, "a", 1, "r"), (None, None, 2, None)], RESULTS), {"f": {"x": "string", "y": "string"}}).collect()
    assert sorted((r.level is None, r.problem) for r in rows) == [(False, "unanswered")] * 3 + [(True, "names a missing call"), (True, "orphan"), (True, "orphan")]
    assert problems(spark, []) == {}
    assert chat_format.format_turns(spark.createDataFrame([], TURNS)).count() == 0


def test_clashing_names_and_long_texts(spark):
    long = "word " * 200_000
    turns = spark.createDataFrame([(1, 0, "user", long, 5, "z"), (1, 1, "assistant", long, 6, "z")], TURNS + ", level int, nth string")
    rows = chat_format.format_turns(turns).collect()
    assert len(rows) == 1 and long in rows[0].call_json and long in rows[0].result_json
