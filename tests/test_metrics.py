"""Literal values for statistics, reliability, cost and routing."""

import pytest
from pyspark.sql import functions as F

from evalgrain.functions import cases as case_functions, text, usage
from evalgrain.operators import execution, gates, routing, stats
from evalgrain.plans import report

USAGE = "struct<input_tokens: double, output_tokens: double, total_tokens: double, tool_calls_total: double>"
CALLS = "array<struct<name: string, count: int>>"


def one(df):
    return df.collect()[0].asDict()


@pytest.mark.parametrize("values, mean, stddev", [
    ([0.8], 0.8, 0.0), ([1.0, 1.0, 0.4], 0.8, pytest.approx(0.3464, abs=1e-4)),
    ([None, None], None, None), ([1.0, None, 3.0], 2.0, pytest.approx(1.4142, abs=1e-4)),
])
def test_stats(spark, values, mean, stddev):
    df = spark.createDataFrame([("r", v) for v in values], "run_id string, x double")
    row = one(stats.stats(df, ["run_id"], "x"))
    assert row["mean"] == (pytest.approx(mean) if mean is not None else None) and row["stddev"] == stddev


def test_tokens(spark):
    df = spark.createDataFrame(
        [((None, None, 500.0, None),), ((100.0, 400.0, None, None),), ((None, None, None, None),)], f"u {USAGE}")
    assert [r[0] for r in df.select(usage.tokens(F.col("u"))).collect()] == [500.0, 500.0, None]


def test_tool_calls(spark):
    none = (None, None, None, None)
    df = spark.createDataFrame([
        ((None, None, None, 7.0), [("a", 1), ("b", 1)]), (none, [("a", 3), ("b", 2)]),
        (none, [("a", None)]), (none, [("a", 0)]), (none, []), (none, None),
    ], f"u {USAGE}, c {CALLS}")
    got = [r[0] for r in df.select(usage.tool_call_count(F.col("u"), F.col("c"))).collect()]
    assert got == [7.0, 5.0, 1.0, 1.0, 0.0, None]


def flags(spark, outcomes):
    data = [("r", case, i, i, ok) for case, oks in outcomes.items() for i, ok in enumerate(oks)]
    return spark.createDataFrame(data, "run_id string, case_id string, repeat_index int, line_no long, done boolean")


def test_flaky_and_pass_at_k(spark, rows):
    df = flags(spark, {"a": [True, False, True], "b": [True, True, True]})
    assert rows(stats.flaky_cases(df, "done")) == [
        {"run_id": "r", "case_id": "a", "passed": 2, "runs": 3, "pass_rate": pytest.approx(0.6667, abs=1e-4)}]
    row = one(stats.pass_rates(df, "done", 3))
    assert (row["pass_at_k"], row["pass_all_k"]) == (1.0, 0.5)
    incomplete = one(stats.pass_rates(flags(spark, {"a": [True]}), "done", 3))
    assert incomplete["pass_at_k"] is None


def test_last_row_of_a_repeat_counts(spark):
    df = spark.createDataFrame([("r", "a", 0, 1, False), ("r", "a", 0, 2, True)],
                               "run_id string, case_id string, repeat_index int, line_no long, done boolean")
    assert one(stats.pass_rates(df, "done", 1))["pass_all_k"] == 1.0


def test_non_discriminating(spark, rows):
    rates = spark.createDataFrame([("b", "x", 1.0), ("b", "y", 0.3), ("t", "x", 1.0), ("t", "y", 1.0)],
                                  "run_id string, case_id string, rate double")
    pairs = spark.createDataFrame([("b", "t")], "baseline string, treatment string")
    assert [r["case_id"] for r in rows(stats.non_discriminating(rates, pairs))] == ["x"]


ROUTED = ("run_id string, case_id string, repeat_index int, line_no long, expected array<string>, "
          "selected array<string>, ok boolean, severity string, type string, stage string, error_kind string")


def routed(spark, data):
    return spark.createDataFrame(data, ROUTED)


def row(case, expected, selected, ok=True, severity="medium", kind="pos"):
    return ("r", case, 0, 1, expected, selected, ok, severity, kind, "trigger", None)


def test_routing_scores(spark):
    data = [row("a", ["x"], ["x"]), row("b", ["x", "y"], ["y", "x", "x"], kind="multi"),
            row("c", [], ["x"], severity="critical", kind="rej"), row("d", [], [], kind="rej", severity="critical"),
            row("e", ["x"], ["y"], ok=False)]
    got = one(routing.scores(routing.judge(routed(spark, data))))
    assert got["exact_set_match"] == 0.75 and got["top1"] == 1.0 and got["multi_exact"] == 1.0
    assert got["no_skill_rejection"] == 0.5 and got["false_activation"] == 0.5 and got["critical_miss"] == 0.5
    assert got["type_amb"] is None


def test_filled_confusion_has_the_labels_of_each_run(spark):
    cells = [("r1", "A", "R", 2), ("r1", "R", "R", 1), ("r2", "X", text.NO_LABEL, 3)]
    matrix = spark.createDataFrame(cells, "run_id string, truth string, predicted string, n bigint")
    got = {tuple(r)[:3]: r.n for r in routing.filled_confusion(matrix).collect()}
    labels = {"r1": "AR", "r2": ["X", text.NO_LABEL]}
    want = {(run, a, b): 0 for run, own in labels.items() for a in own for b in own}
    assert got == want | {c[:3]: c[3] for c in cells}


def test_missing_metric_is_null_and_skips_its_gate(spark, rows):
    scores = routing.long_scores(routing.scores(routing.judge(routed(spark, [row("a", ["x"], ["x"])]))), routing.METRICS)
    dim = spark.createDataFrame([("r", {"critical_miss": "<= 0", "top1": ">= 0.9"}, False)],
                                "run_id string, gate map<string,string>, mock boolean")
    checked = {r["metric"]: r["pass"] for r in rows(gates.check_gate(gates.explode_gate(dim), scores))}
    assert checked == {"critical_miss": None, "top1": True}


def test_nan_never_passes_a_gate(spark, rows):
    dim = spark.createDataFrame([("r", {"m": ">= 0.9"}, False)], "run_id string, gate map<string,string>, mock boolean")
    scores = spark.createDataFrame([("r", "m", float("nan"))], "run_id string, metric string, value double")
    assert rows(gates.check_gate(gates.explode_gate(dim), scores))[0]["pass"] is None


@pytest.mark.parametrize("facts, verdict, reason", [
    ((10, 0, True, False), "pass", "gate passed"), ((10, 0, False, False), "fail", "gate failed"),
    ((10, 10, False, False), "indeterminate", "every run is an infrastructure failure"),
    ((0, 0, None, False), "indeterminate", "no runs recorded"),
    ((None, None, None, False), "indeterminate", "no runs recorded"),
    ((5, 1, None, False), "indeterminate", "no gate metric could be judged"),
    ((5, 0, True, True), "not_evaluated", "synthetic run"),
])
def test_verdict(spark, facts, verdict, reason):
    df = spark.createDataFrame([facts], "n_runs long, n_system_failures long, observed_passed boolean, mock boolean")
    got = one(gates.derive_verdict(df))
    assert (got["quality_verdict"], got["reason"]) == (verdict, reason)
    assert (got["gate_pass"] is not None) == (verdict in ("pass", "fail"))


TURN = ("run_id string, case_id string, repeat_index int, turn_index int, line_no long, type string, stage string, "
        "severity string, session_id string, skipped boolean, requires_context boolean, ok boolean, error_kind string, "
        "skill_injected boolean, art_hits int, art_total int, tool_hits int, tool_total int, workspace_hits int, "
        "workspace_total int, n_artifacts int, done boolean")


def turn(case, index, done=True, skipped=False, session="s", kind=None, repeat=0, workspace=1):
    return ("r", case, repeat, index, index, "pos", "artifact", "critical", session, skipped, index > 1, done, kind, True,
            1, 1, 0, 0, workspace, 1, 1, done)


def test_two_turns_one_session(spark):
    got = one(execution.scores(spark.createDataFrame([turn("a", 1), turn("a", 2)], TURN)))
    for metric in ("task_completion", "turn_completion", "session_continuity", "context_retention", "file_state_continuity"):
        assert got[metric] == 1.0
    assert got["tool_hit"] is None and got["critical_miss"] == 0.0


def test_failed_then_skipped(spark):
    got = one(execution.scores(spark.createDataFrame(
        [turn("a", 1, done=False), turn("a", 2, done=False, skipped=True)], TURN)))
    assert got["task_completion"] == 0.0 and got["turn_completion"] == 0.0 and got["session_continuity"] is None


def test_system_failure_leaves_the_denominator(spark):
    df = spark.createDataFrame([turn("a", 1), turn("b", 1, done=False, kind="network"),
                                turn("b", 2, done=False, skipped=True)], TURN)
    values = {r["metric"]: r["value"] for r in report.execution_scores(df, 1).collect()}
    assert values["task_completion"] == 1.0 and values["pass_at_k"] == 1.0


def test_repeated_turn_key_is_another_conversation(spark):
    df = spark.createDataFrame([turn("a", 1), turn("a", 1, done=False)], TURN) \
        .withColumn("line_no", F.monotonically_increasing_id())
    assert one(execution.scores(df))["task_completion"] == 0.5


def test_empty_input(spark):
    empty = spark.createDataFrame([], TURN)
    assert execution.scores(empty).count() == 0
    dim = spark.createDataFrame([("r", {"top1": ">= 0.9"}, False)], "run_id string, gate map<string,string>, mock boolean")
    nothing = routed(spark, [])
    verdict = report.verdicts(dim, nothing, report.routing_scores(nothing))
    assert [r["quality_verdict"] for r in verdict.collect()] == ["indeterminate"]


@pytest.mark.parametrize("tags, stage, artifacts, logic, want", [
    (["Robustness"], None, True, True, "failure"), (["x"], None, True, True, "artifact"),
    (["x"], None, False, True, "logic"), (None, None, False, False, "trigger"), (["error"], "logic", True, True, "logic"),
])
def test_case_stage(spark, tags, stage, artifacts, logic, want):
    df = spark.createDataFrame([(tags, stage)], "tags array<string>, stage string")
    got = df.select(case_functions.case_stage(F.col("stage"), F.col("tags"), F.lit(artifacts), F.lit(logic))).first()[0]
    assert got == want


@pytest.mark.parametrize("message, want", [
    ("Arrearage: account", "provider_quota_exhausted"), ("Forbidden", "provider_authentication"),
    ("getaddrinfo ENOTFOUND", "network_dns"), ("request timed out", "network_timeout"),
    ("rate limit", "provider_rate_limited"), ("reset", "network_connectivity"),
])
def test_error_subkind(spark, message, want):
    df = spark.createDataFrame([("network", message), ("task", message)], "k string, m string")
    assert [r[0] for r in df.select(text.error_subkind(F.col("k"), F.col("m"))).collect()] == [want, None]


def test_normalize_prompt_unicode(spark):
    df = spark.createDataFrame([("  A　b C\n",)], "p string")
    assert df.select(text.normalize_prompt(F.col("p"))).first()[0] == "a b c"


def test_reason_of_stop(spark):
    df = spark.createDataFrame(
        [("l", 3, True, 3, 100, 4, 100, 10), ("l", 1, False, 3, 5, 1, 100, 10)],
        "lineage_id string, iteration long, gate_pass boolean, max_iterations int, cum_total_tokens long, "
        "cum_total_seconds long, max_total_tokens long, max_total_seconds long")
    got = {r["iteration"]: (r["stop_reason"], r["triggered"]) for r in stats.stop_decision(df).collect()}
    assert got == {3: ("gate_pass", ["gate_pass", "budget_exceeded", "max_iterations"]), 1: (None, [])}
