"""Literal trajectories: arguments, order, state and read-back."""

import json

import pytest
from pyspark.sql import functions as F

from evalgrain.functions import arguments as args, files
from evalgrain.operators import trajectory

K = ["run_id"]
EVENT = ("run_id string, step_index long, event_type string, tool_name string, call_id string, "
         "arguments_json string, status string, evidence_level string")


def events(spark, *rows):
    return spark.createDataFrame([("r", *r) for r in rows], EVENT) \
        .withColumn("arguments", F.parse_json("arguments_json")).drop("arguments_json")


def call(step, tool, arguments=None, level="exact", call_id=None):
    return (step, "tool_call", tool, call_id or f"c{step}", json.dumps(arguments) if arguments is not None else None,
            "started", level)


def result(step, tool, call_id, status="success"):
    return (step, "tool_result", tool, call_id, None, status, "exact")


def assertion(spark, tool, path, matcher, equals=None, allowed=None, matches=None):
    df = spark.createDataFrame(
        [("r", 0, tool, path, matcher, json.dumps(equals) if equals is not None else None,
          [json.dumps(a) for a in allowed] if allowed else None, matches)],
        "run_id string, assertion_index int, tool string, path string, matcher string, e string, i array<string>, matches string")
    return df.withColumn("equals", F.parse_json("e")).withColumn("in_values", F.transform("i", F.parse_json)).drop("e", "i")


def score(spark, log, rule):
    return trajectory.argument_scores(log, rule, K).first()["score"]


ARGUMENTS = {"path": "out/report.md", "options": {"format": "md", "n": 2, "ok": True, "list": ["a", None]}}


@pytest.mark.parametrize("rule, want", [
    (("write", "path", "required"), 1.0), (("write", "options.list.1", "required"), 1.0),
    (("write", "options.list.2", "required"), 0.0), (("write", "nope", "forbidden"), 1.0),
    (("write", "path", "forbidden"), 0.0), (("write", "options.format", "equals", "md"), 1.0),
    (("write", "options.format", "equals", "csv"), 0.0), (("write", "options.n", "equals", 2.0), 1.0),
    (("write", "options.ok", "equals", 1), 0.0), (("write", "options.format", "in", None, ["csv", "md"]), 1.0),
    (("write", "path", "matches", None, None, r"report\.md$"), 1.0), (("write", "options.n", "matches", None, None, "2"), 0.0),
    (("read", "path", "required"), 0.0),
])
def test_matchers(spark, rule, want):
    assert score(spark, events(spark, call(1, "write", ARGUMENTS)), assertion(spark, *rule)) == want


@pytest.mark.parametrize("log, rule, want", [
    ([call(1, "write", {"a": 1}, level="coarse")], ("write", "a", "required"), None),
    ([call(1, "write")], ("write", "a", "required"), None),
    ([call(1, "write")], ("write", "a", "equals", "x"), None),
    ([call(1, "write", {"a": "<redacted>"})], ("write", "a", "equals", "x"), None),
    ([call(1, "write", {"a": "long…[truncated at 500 of 900 chars]"})], ("write", "a", "matches", None, None, "zz"), None),
    ([call(1, "write", {"a": "<redacted>"}), call(2, "write", {"a": "x"})], ("write", "a", "equals", "x"), 1.0),
    ([call(1, "write", {"a": None})], ("write", "a", "required"), 1.0),
])
def test_unknown_is_not_failure(spark, log, rule, want):
    assert score(spark, events(spark, *log), assertion(spark, *rule)) == want


def expectation(spark, required=(), forbidden=(), order=(), state=False, verify=False, probes=()):
    return spark.createDataFrame(
        [("r", list(required), list(forbidden), list(order), state, verify, list(probes))],
        "run_id string, required_tools array<string>, forbidden_tools array<string>, required_order array<string>, "
        "required_state_change boolean, required_verification boolean, verification_tools array<string>")


def test_selection(spark):
    log = events(spark, call(1, "write", level="coarse"))
    got = trajectory.tool_selection(
        expectation(spark, ["write", "read"], ["rm"]), trajectory.observed_tools(log, K), K).first()[1]
    assert got == pytest.approx(2 / 3)
    assert trajectory.tool_selection(expectation(spark), trajectory.observed_tools(log, K), K).first()[1] is None


@pytest.mark.parametrize("block", [1, 2, 4096])
@pytest.mark.parametrize("tools, order, want", [
    (["read", "write"], ["read", "write"], 1.0), (["write", "read"], ["read", "write"], 0.5),
    (["a", "read", "read", "b", "write"], ["read", "read", "write", "read"], 0.75), (["x"], ["read"], 0.0),
])
def test_order(spark, tools, order, want, block):
    log = events(spark, *[call(i + 1, t, {}) for i, t in enumerate(tools)])
    assert trajectory.order_correctness(log, expectation(spark, order=order), K, block).first()[1] == want


def test_order_without_exact_calls(spark):
    log = events(spark, call(1, "read", {}, level="coarse"))
    assert trajectory.order_correctness(log, expectation(spark, order=["read"]), K).count() == 0


def artifacts(spark, *paths):
    return spark.createDataFrame([("r", p) for p in paths], "run_id string, path string")


def test_state(spark):
    log = events(spark, call(1, "write", {}))
    asked = expectation(spark, state=True)
    assert trajectory.state_persistence(asked, log, artifacts(spark, "a.md"), K).first()[1] == 1.0
    assert trajectory.state_persistence(asked, log, artifacts(spark).limit(0), K).first()[1] == 0.0


READBACK = [
    call(1, "write", {"file": "/w/out/a.md", "body": "see out/b.md for more"}), call(2, "write", {"file": "out/b.md"}),
    call(3, "read", {"nested": [{"p": "out/a.md"}]}), result(4, "read", "c3"),
    call(5, "read", {"p": "out/b.md"}), result(6, "read", "c5", "failed"),
]


def test_readback(spark):
    asked = expectation(spark, verify=True, probes=["read"])
    both = artifacts(spark, "out/a.md", "out/b.md", "never-written.txt")
    row = trajectory.readback_rate(asked, events(spark, *READBACK), both, K).first()
    assert (row["produced"], row["verified"], row["readback_rate"]) == (2, 1, 0.5)
    none = expectation(spark, verify=True)
    assert trajectory.verification_rate(none, events(spark, *READBACK), both, K).first()[1] is None
    reported = events(spark, *READBACK, (7, "verification", None, None, None, "success", "exact"))
    assert trajectory.verification_rate(asked, reported, both, K).first()[1] == 1.0


def test_read_before_write_is_no_proof(spark):
    asked = expectation(spark, verify=True, probes=["read"])
    log = events(spark, call(1, "read", {"p": "a.md"}), result(2, "read", "c1"), call(3, "write", {"p": "a.md"}))
    assert trajectory.readback_rate(asked, log, artifacts(spark, "a.md"), K).first()["readback_rate"] == 0.0


def test_argument_strings(spark):
    value = {"k\"ey": "v:1", "n": 3, "deep": [{"x": "quote\" and \\ back"}, "end"]}
    df = spark.createDataFrame([(json.dumps(value),)], "j string")
    got = df.select(trajectory.argument_strings(F.parse_json("j"))).first()[0]
    assert sorted(got) == sorted(["v:1", "quote\" and \\ back", "end"])


def test_redaction(spark):
    value = {"api_key": "k", "body": "x" * 900, "list": list(range(25)), "deep": {"Authorization": {"a": 1}, "ok": "s"}}
    df = spark.createDataFrame([(json.dumps(value),), ('{"plain":1}',)], "j string")
    got = [json.loads(r[0]) for r in df.select(F.to_json(args.redact_arguments(F.parse_json("j")))).collect()]
    assert got[0]["api_key"] == "<redacted>" and got[0]["deep"] == {"Authorization": "<redacted>", "ok": "s"}
    assert got[0]["body"] == "x" * 900 and got[0]["list"] == list(range(25))
    assert got[1] == {"plain": 1}
    shown = json.loads(df.select(args.display_arguments(F.parse_json("j"))).first()[0])
    assert shown["body"].endswith("…[truncated at 500 of 900 chars]") and len(shown["list"]) == 20
    assert shown["api_key"] == "<redacted>"


@pytest.mark.parametrize("text, want", [
    ('{"n":12345678901234567.891,"token":[1,{"a":"]"}],"t":"x"}', '{"n":12345678901234567.891,"token":"<redacted>","t":"x"}'),
    ('{"a":[{"secret":"q\\"}"},{"b":"token: \\u00e9"}],"c":null}', '{"a":[{"secret":"<redacted>"},{"b":"token: é"}],"c":null}'),
    ('{"password":true,"token":{}}', '{"password":"<redacted>","token":"<redacted>"}'), ('"token"', '"token"'), ('[]', '[]')])
def test_masking_keeps_the_rest(spark, text, want):
    def read(line):
        return json.loads(line, parse_float=str)

    long = "x" * 5000
    lines = [text, f'{{"long":"{long}","v":{text}}}']
    df = spark.createDataFrame([(line,) for line in lines], "j string")
    got = [read(r[0]) for r in df.select(F.to_json(args.redact_arguments(F.parse_json("j")))).collect()]
    assert got == [read(want), {"long": long, "v": read(want)}]


@pytest.mark.parametrize("value, pattern, want", [
    ("报告", r"^\w+$", True), ("１２", r"^\d+$", True), ("ab", "(?P<one_a>a)(?P<b>b)", True), ("abab", "(?P<x>ab)(?P=x)", True),
    ("a", "(", None), (None, "a", None), ("b", "a", False)])
def test_regex_dialect(spark, value, pattern, want):
    df = spark.createDataFrame([(value, pattern), ("z", "z")], "t string, p string")
    assert [r[0] for r in df.select(args.regex_found("t", "p")).collect()] == [want, True]


def test_missing_lists_are_empty(spark):
    tools, arts = "array<struct<name: string, count: int, failures: int>>", \
        "array<struct<path: string, sha256: string, size_bytes: bigint, change: string>>"
    df = spark.createDataFrame([(1, None, None), (2, [("t", 1, 0)], None), (3, None, [("a", "h", 1, "new")])],
                               f"id int, tool_calls {tools}, artifacts {arts}") \
        .withColumn("exact_events", F.lit(None).cast(f"array<{trajectory.EVENT}>"))
    got = {r["id"]: [(e["event_type"], e["step_index"]) for e in r["trajectory"]]
           for r in trajectory.normalize_trajectory(df).select("id", F.transform("trajectory", lambda e: F.struct(
               e["event_type"].alias("event_type"), e["step_index"].alias("step_index"))).alias("trajectory")).collect()}
    assert got == {1: [("final", 1)], 2: [("tool_call", 1), ("final", 2)], 3: [("state_change", 1), ("final", 2)]}


@pytest.mark.parametrize("pattern, path, want", [
    ("out/q3.csv", "out/q3.csv", True), ("out/*.md", "out/deep/a.md", True), ("*.md", "a.MD", False),
    ("a?c", "abc", True), ("[!a]bc", "xbc", True), ("[!a]bc", "abc", False), ("[", "[", True), ("a.b", "axb", False),
])
def test_glob(spark, pattern, path, want):
    df = spark.createDataFrame([(pattern, path)], "g string, p string")
    assert df.select(F.regexp_like("p", files.glob_regex(F.col("g")))).first()[0] is want


@pytest.mark.parametrize("size, mime, want", [(10, "text/csv", True), (0, "text/csv", False), (None, None, False),
                                              (10, "text/html", False), (10, None, True)])
def test_artifact_hit(spark, size, mime, want):
    df = spark.createDataFrame([([("out/a.csv", size, mime)],)],
                               "a array<struct<path: string, size_bytes: bigint, mime_type: string>>")
    pattern = F.lit("out/*.csv")
    assert df.select(files.artifact_hit(files.glob_regex(pattern), files.guess_mime(pattern), F.col("a"))).first()[0] is want
