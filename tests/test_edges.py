"""Empty input, all-NULL input, and one key that holds most rows."""

import pytest
from pyspark.sql import functions as F

from evalgrain.operators import (
    calibration, caseset, compare, evidence, execution, gates, joins, judging, routing, stats, trajectory)

K = ["run_id"]


def test_empty_tables(spark):
    def empty(ddl):
        return spark.createDataFrame([], ddl)

    events = empty("run_id string, step_index long, event_type string, tool_name string, call_id string, "
                   "arguments variant, status string, evidence_level string")
    expected = empty("run_id string, required_tools array<string>, forbidden_tools array<string>, "
                     "required_order array<string>, required_state_change boolean, "
                     "required_verification boolean, verification_tools array<string>")
    rules = empty("run_id string, assertion_index int, tool string, path string, matcher string, equals variant, "
                  "in_values array<variant>, matches string")
    files = empty("run_id string, path string")
    scores = empty("run_id string, metric string, value double")
    cases = empty("set_id string, id string, prompt string, gold array<string>, line_no long")
    for df in (
        trajectory.score_structured(empty("run_id string"), expected, events, rules, files, K),
        stats.stats(empty("run_id string, x double"), K, "x"),
        stats.pass_rates(empty("run_id string, case_id string, repeat_index int, line_no long, done boolean"), "done", 3),
        routing.top_confusions(empty("run_id string, truth string, predicted string, n long")),
        caseset.case_set_issues(cases, empty("skill_id string"), empty("set_id string")),
        compare.metric_delta(scores, empty("set_id string, run_id string, baseline string")),
        gates.check_gate(gates.explode_gate(empty("run_id string, gate map<string,string>")), scores),
        judging.dimension_means(empty("run_id string, dimension string, score double"), K),
        calibration.invalid_output_rate(empty("judge_id string, failed boolean"), ["judge_id"]),
    ):
        assert df.count() == 0


def test_empty_set_is_an_issue(spark):
    cases = spark.createDataFrame([], "set_id string, id string, prompt string, gold array<string>, line_no long")
    sets = spark.createDataFrame([("s",)], "set_id string")
    found = caseset.case_set_issues(cases, sets.select(F.col("set_id").alias("skill_id")), sets).collect()
    assert [(r["set_id"], r["problem"]) for r in found] == [("s", "empty set")]


def test_all_null_telemetry(spark):
    runs = spark.createDataFrame(
        [("r", None, None, None, None)] * 3,
        "run_id string, duration_ms long, usage struct<input_tokens: double, output_tokens: double, "
        "total_tokens: double, tool_calls_total: double>, tool_calls array<struct<name: string, count: int>>, "
        "error_kind string")
    got = {r["metric"]: (r["mean"], r["stddev"], r["n"]) for r in stats.efficiency(runs).collect()}
    assert got == {"time_seconds": (None, None, 0), "tokens": (None, None, 0), "tool_calls": (None, None, 0),
                   "errors": (0.0, 0.0, 3)}
    totals = stats.run_usage(runs).first()
    assert (totals["runs_missing_tokens"], totals["runs_missing_duration"], totals["total_tokens"]) == (3, 3, 0)


def test_null_expectations_are_not_applicable(spark):
    rows = spark.createDataFrame(
        [("r", "a", 0, 1, None, None, None, None, None, None)],
        "run_id string, case_id string, repeat_index int, line_no long, expected array<string>, "
        "selected array<string>, ok boolean, severity string, type string, stage string")
    got = routing.scores(routing.judge(rows)).first()
    assert got["exact_set_match"] == 1.0 and got["no_skill_rejection"] == 1.0
    assert got["top1"] is None and got["critical_miss"] is None and got["stage_logic"] is None


def test_unknown_gate_text(spark):
    dim = spark.createDataFrame([("r", {"a": ">= 1.5", "b": "> 0.5", "c": ">= 0.25"})],
                                "run_id string, gate map<string,string>")
    assert sorted(r["metric"] for r in gates.gate_violations(gates.explode_gate(dim)).collect()) == ["a", "b"]


def test_skewed_case_is_split(spark):
    """A case with a third of the runs is joined by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        runs = spark.range(0, 60000, numPartitions=6).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("case_id"),
            F.lit(1).alias("turn_index"), F.sha2(F.col("id").cast("string"), 256).alias("output"))
        turns = runs.select("case_id", "turn_index").distinct().withColumn("gold", F.upper("case_id"))
        joined = joins.runs_with_case(runs, turns)
        assert len(joined.collect()) == 60000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("models, repeats", [([], 1), (["a", "a"], 1), (["a", ""], 1), (["a"], 0)])
def test_matrix_refuses_bad_axes(spark, models, repeats):
    cases = spark.createDataFrame([("c",)], "case_id string")
    with pytest.raises(ValueError):
        joins.build_matrix(cases, models, repeats, "s", "e")


def test_matrix_ids(spark):
    cases = spark.createDataFrame([("a b", 2), ("c", 1)], "case_id string, turns int")
    got = joins.build_matrix(cases, ["m/1"], 2, "s", "e+1", turn_count=F.col("turns")).collect()
    assert len(got) == 6
    assert {r["request_id"] for r in got if r["case_id"] == "c"} == {"s.m-1.c.t1.r0", "s.m-1.c.t1.r1"}
    assert {r["session_id"] for r in got if r["case_id"] == "a b" and r["repeat_index"] == 0} == {"eval.e+1.s.m-1.a-b.r0"}


@pytest.mark.parametrize("n, with_multi, want", [
    (30, False, {"pos": 12, "amb": 9, "rej": 9}), (10, True, {"pos": 4, "amb": 3, "rej": 2, "multi": 1}),
    (4, True, {"pos": 1, "amb": 1, "rej": 1, "multi": 1})])
def test_expected_mix(spark, n, with_multi, want):
    sets = spark.createDataFrame([("s", n)], "set_id string, n_cases int")
    assert {r["case_type"]: r["quota"] for r in caseset.expected_mix(sets, with_multi).collect()} == want


def test_a_set_too_small_for_a_mix_is_named(spark):
    sets = spark.createDataFrame([("s", 3), ("t", 4)], "set_id string, n_cases int")
    cases = spark.createDataFrame([("s", "a-pos-01")], "set_id string, id string")
    got = caseset.mix_check(cases, caseset.expected_mix(sets, True)).filter("set_id = 's'").collect()
    assert [(r["case_type"], r["quota"], r["actual"], r["problem"]) for r in got] == [(None, None, None, "too few cases")]


@pytest.mark.parametrize("shift, agreement, error", [(-0.2, 1.0, 0.2), (-0.4, 0.0, 0.4)])
def test_dimension_agreement(spark, shift, agreement, error):
    columns = "calibration_id string, judge_id string, case_id string, repeat_index int, turn_index int, dimension string, score double"
    gold = spark.createDataFrame([("c", "j", f"x{i}", 0, 1, "relevancy", 0.9) for i in range(10)], columns)
    judged = gold.withColumn("score", F.col("score") + shift)
    row = calibration.dimension_agreement(gold, judged).first()
    assert row["agreement"] == agreement and row["mean_absolute_error"] == pytest.approx(error)


def test_registry_keeps_the_first_of_equal_records(spark):
    records = spark.createDataFrame(
        [("s", None, "f", 0.9, 0.0, 1, "first"), ("s", None, "f", 0.9, 0.0, 2, "second"), ("s", None, "f", 0.8, 0.0, 0, "low")],
        "scope string, dimension string, fingerprint string, agreement double, invalid_output_rate double, position int, name string")
    row = calibration.registry_best(records).first()
    assert (row["name"], row["dimension"]) == ("first", None)


def test_duplicate_prompts_against_first(spark):
    cases = spark.createDataFrame(
        [("s", "a-pos-01", "Do  It", ["x"], 1), ("s", "b-pos-02", "do it", ["y"], 2), ("s", "c-pos-03", " do\tit ", ["x"], 3)],
        "set_id string, id string, prompt string, gold array<string>, line_no long")
    got = {r["id"]: (r["first_id"], r["problem"]) for r in caseset.duplicate_prompts(cases).collect()}
    assert got == {"b-pos-02": ("a-pos-01", "same prompt, other gold"), "c-pos-03": ("a-pos-01", "duplicate prompt")}


def test_retention(spark):
    owners = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "x")], "path string, owner string")
    tracked = spark.createDataFrame([("d",)], "path string")

    def plan(selected, associations=None):
        chosen = spark.createDataFrame([(s,) for s in selected], "owner string")
        return {r["path"]: r["action"] for r in joins.retention_plan(owners, chosen, tracked, associations).collect()}

    assert plan(["x"]) == {"a": "remove_after_verify", "b": "retain_shared", "d": "retain_tracked"}
    assert plan(["x", "y"])["b"] == "remove_after_verify"
    related = spark.createDataFrame([("c", "x"), ("n", "x")], "path string, owner string")
    assert plan(["x"], related) == {"c": "retain_shared", "n": "retain_shared"}


def test_inline_secrets(spark):
    configs = spark.createDataFrame([("a", '{"models": [{"api_key_env": "X", "Api-Key": "v"}], "n": {"password_id": 1}}'),
                                     ("b", '{"deep": {"er": {"est": {"secret": 1}}}}'),
                                     ("c", '{"d": ' * 12 + '{"secret": 1}' + "}" * 12)], "config_id string, j string") \
        .select("config_id", F.parse_json("j").alias("config"))
    got = {(r["config_id"], r["path"], r["problem"]) for r in caseset.inline_secrets(configs).collect()}
    assert got == {("a", "suite.models[0].Api-Key", "inline secret"),
                   ("b", "suite.deep.er.est.secret", "inline secret"), ("c", "suite" + ".d" * 12 + ".secret", "inline secret")}


def test_gradings_meet_failures_after_each_side_is_judged(spark, rows):
    """The same rows whether gradings stand beside the runs or are joined last; files lose what nobody reads before joins."""
    file = "array<struct<path: string, sha256: string, size_bytes: bigint, mime_type: string, text_excerpt: string>>"
    runs = execution.scored_part(spark.range(6).select(
        F.lit("r").alias("run_id"), F.concat(F.lit("c"), "id").alias("case_id"), F.lit(0).alias("repeat_index"),
        F.lit(1).alias("turn_index"), F.when(F.col("id") == 1, "failed").otherwise("success").alias("status"),
        F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("string").alias("error"),
        F.array(F.struct(F.lit("out/a"), F.lit("h"), F.lit(1), F.lit(None), F.lit("text"))).cast(file).alias("artifacts"),
        F.array(F.struct(F.lit("read").alias("name"), F.lit(1).alias("count"))).alias("tool_calls"),
        *(F.array().cast("array<string>").alias(c) for c in
          ("workspace_files", "loaded_skills", "selected_skills", "expected_skills", "expect_workspace_files", "expect_tools")),
        F.when(F.col("id") == 2, F.array(F.lit("out/b"))).otherwise(F.array()).cast("array<string>").alias("expect_artifacts"),
        (F.col("id") == 3).alias("forbid_artifacts"),
        *(F.lit(None).cast("string").alias(c) for c in ("final_answer", "raw_output", "reasoning"))))
    assert runs.schema["artifacts"].dataType.elementType.names == ["path", "size_bytes", "mime_type", "text_excerpt"]
    assert runs.schema["tool_calls"].dataType.elementType.names == ["name"]
    gradings = spark.range(4, 5).select(
        F.lit("r").alias("run_id"), F.concat(F.lit("c"), "id").alias("case_id"), F.lit(0).alias("repeat_index"),
        F.lit(1).alias("turn_index"),
        F.array(F.struct(F.lit("claim").alias("text"), F.lit(False).alias("passed"), F.lit("seen").alias("evidence"))).alias("expectations"),
        F.array(F.struct(F.lit("tone").alias("dimension"), F.lit(0.5).alias("score"), F.lit("s").alias("evidence"))).alias("dimensions"))
    expected = execution.compile_expectations(runs)
    found = rows(evidence.full_failures(expected, gradings))
    assert found == rows(evidence.full_failures(joins.runs_with_grading(expected, gradings)))
    assert [(r["case_id"], r["metric"]) for r in found] == [
        ("c1", "task_completion"), ("c2", "task_completion"), ("c3", "task_completion"), ("c4", "assertion")]
    assert "failed assertions: claim | seen\nlow dimensions: tone=0.5" in found[3]["failure_detail"]


def test_own_owners_leave_before_references_are_multiplied(spark, rows):
    """One path with owners of its own stands in many datasets: it meets no dataset's owners in the join."""
    owners = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 2)], "dataset string, owner int")
    references = spark.createDataFrame(
        [("d1", "p", "suite"), ("d2", "p", "suite"), ("d1", "q", "run"), ("d2", "q", "run")], "dataset string, path string, category string")
    explicit = spark.createDataFrame([("p", 9)], "path string, owner int")
    found = joins.propagate_owners(owners, references, explicit)
    assert [(r["path"], r["owner"]) for r in rows(found)] == [
        ("d1", 1), ("d1", 2), ("d2", 2), ("p", 9), ("q", 1), ("q", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Join Inner") < plan.find("Join LeftAnti")


def test_tasks_of_queries_stay_small(spark):
    from evalgrain.plans import all_queries
    from evalgrain.plans.catalog import TASK_DATA

    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    all_queries()["E3_occurrences"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == TASK_DATA == "16m"


def test_arrow_batches_of_queries_stay_small(spark):
    """A batch of whole documents is held several times by each Python worker."""
    from evalgrain.plans import all_queries

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    all_queries()["B11_sanitize_arguments"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
