"""From files on disk to scores and verdicts."""

import json

import pytest
from pyspark.sql import functions as F

from evalgrain.operators import evidence, execution, inspection, joins, trajectory
from evalgrain.plans import report
from evalgrain.sources.cases import read_cases
from evalgrain.sources.runs import read_run_dim, read_runs

CASES = [
    {"id": "pdf-pos-01", "prompt": "read it", "expected_skills": ["pdf"], "severity": "critical",
     "expect_artifacts": ["out/*.md"], "expect_tools": ["write"],
     "expect_trajectory": {"required_tools": ["write"], "required_order": ["read", "write"]},
     "turns": [{"prompt": "again", "requires_context": True, "expect_workspace_files": ["out/a.md"]}]},
    {"id": "none-rej-01", "prompt": "hello", "forbid_artifacts": True},
]
GOOD = {"path": "out/a.md", "sha256": "x", "size_bytes": 5, "mime_type": "text/markdown"}


def event(step, tool):
    return {"step_index": step, "event_type": "tool_call", "name": tool, "tool_name": tool, "call_id": f"c{step}",
            "arguments": {"path": "out/a.md"}, "status": "started", "evidence_level": "exact"}


def run(case, turn=1, repeat=0, **fields):
    base = {"case_id": case, "repeat_index": repeat, "turn_index": turn, "model": "m", "status": "success",
            "session_id": f"{case}-{repeat}", "selected_skills": [], "loaded_skills": ["pdf", "other"],
            "tool_calls": [], "artifacts": [], "workspace_files": [], "trajectory": []}
    return json.dumps({**base, **fields})


RUNS = [
    run("pdf-pos-01", selected_skills=["pdf"], tool_calls=[{"name": "write"}], artifacts=[GOOD],
        trajectory=[event(1, "read"), event(2, "write")]),
    run("pdf-pos-01", turn=2, workspace_files=["out/a.md"]),
    run("none-rej-01", selected_skills=["pdf"], artifacts=[GOOD]),
    run("pdf-pos-01", repeat=1, status="failed", error="HTTP 429", error_kind="network"),
    run("pdf-pos-01", repeat=1, turn=2, status="skipped", skip_reason="previous turn t1"),
]
SNAPSHOT = {"suite": {"suite_id": "s", "repeats": 1, "scoring": {"gate": {"task_completion": ">= 0.5", "top1": ">= 0.9"}}},
            "skill_catalog": ["pdf"], "mock": False}


@pytest.fixture
def lake(spark, tmp_path):
    for name, lines in (("e1", RUNS), ("e2", [run("pdf-pos-01", status="failed", error="x", error_kind="harness")])):
        folder = tmp_path / "g" / name
        folder.mkdir(parents=True)
        (folder / "runs.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
        (folder / "config.snapshot.json").write_text(json.dumps(SNAPSHOT), encoding="utf-8")
    (tmp_path / "cases.jsonl").write_text("# note\n" + "\n".join(json.dumps(c) for c in CASES), encoding="utf-8")
    runs = read_runs(spark, str(tmp_path / "g" / "*" / "runs.jsonl"))
    cases, rejects = read_cases(spark, str(tmp_path / "cases.jsonl"))
    assert rejects.count() == 0
    dim = read_run_dim(spark, str(tmp_path / "g" / "*" / "config.snapshot.json")).select("*", "suite.scoring.gate")
    return runs, report.case_table(cases), dim


def test_execution_report(lake):
    runs, cases, dim = lake
    turns = report.execution_turns(runs, cases, dim)
    values = {(r["run_id"], r["metric"]): r["value"] for r in report.execution_scores(turns, 1).collect()}
    assert values["g/e1", "task_completion"] == 0.5 and values["g/e1", "critical_miss"] == 0.0
    assert values["g/e1", "artifact_hit"] == 1.0 and values["g/e1", "file_state_continuity"] == 1.0
    assert values["g/e1", "session_continuity"] == 1.0 and values["g/e1", "context_retention"] == 1.0
    assert ("g/e2", "task_completion") not in values
    scores = report.execution_scores(turns, 1)
    verdicts = {r["run_id"]: r["quality_verdict"] for r in report.verdicts(dim, runs, scores).collect()}
    assert verdicts == {"g/e1": "pass", "g/e2": "indeterminate"}
    injected = {r["run_id"]: r["skill_injected"] for r in execution.turn_scores(
        joins.drop_system_conversations(turns)).collect()}
    assert injected == {"g/e1": 1.0}


def test_routing_report(lake):
    runs, cases, dim = lake
    first = runs.filter("turn_index = 1").withColumnRenamed("selected_skills", "selected")
    values = {(r["run_id"], r["metric"]): r["value"]
              for r in report.routing_scores(report.routing_rows(first, cases), 1).collect()}
    assert values["g/e1", "exact_set_match"] == 0.5 and values["g/e1", "false_activation"] == 1.0
    assert values["g/e1", "stage_artifact"] == 0.5 and values["g/e1", "type_multi"] is None


def test_trajectory_from_records(lake):
    runs, cases, _ = lake
    keys = joins.RUN_KEY
    expected = joins.runs_with_case(runs.select(*keys), joins.resolve_turns(cases)) \
        .filter("expect_trajectory IS NOT NULL").select(*keys, "expect_trajectory.*")
    events = trajectory.explode_events(runs, keys)
    order = trajectory.order_correctness(events, expected, keys).collect()
    assert [r["order_correctness"] for r in order] == [1.0]
    summary = runs.select(*keys, F.explode("tool_calls").alias("t")).select(*keys, "t.name")
    chosen = trajectory.tool_selection(expected, trajectory.observed_tools(events, keys, summary), keys).collect()
    assert sorted(r["tool_selection"] for r in chosen) == [0.0, 0.0, 1.0]


def test_datasets_that_share_case_ids(lake):
    runs, cases, dim = lake
    dim = dim.withColumn("dataset_hash", F.when(F.col("run_id") == "g/e1", "new").otherwise("old"))
    both = cases.withColumn("dataset_hash", F.lit("new")).unionByName(
        cases.withColumn("dataset_hash", F.lit("old")).withColumn("expected", F.array(F.lit("docx"))))
    rows = report.routing_rows(joins.with_dataset(runs, dim).withColumnRenamed("selected_skills", "selected"), both)
    alone = report.routing_rows(runs.withColumnRenamed("selected_skills", "selected"), cases)
    columns = ["run_id", "case_id", "repeat_index", "line_no", "expected"]
    assert rows.filter("run_id = 'g/e1'").select(columns).exceptAll(
        alone.filter("run_id = 'g/e1'").select(columns)).count() == 0
    assert rows.count() == alone.count()
    assert {tuple(r["expected"]) for r in rows.filter("run_id = 'g/e2'").collect()} == {("docx",)}
    assert report.execution_turns(runs, both, dim).count() == report.execution_turns(runs, cases, dim).count()
    records = inspection.inspect_records(joins.with_dataset(runs, dim), both.withColumn("expected_skills", F.col("expected")))
    assert records.count() == runs.count()
    with pytest.raises(ValueError):
        joins.runs_with_case(runs, both)


def test_inspection_and_evidence(lake, rows):
    runs, cases, dim = lake
    gold = cases.select("case_id", "prompt", F.col("expected").alias("expected_skills"))
    records = inspection.inspect_records(runs, gold)
    assert {(r["run_id"], r["status"]): r["n"] for r in inspection.status_counts(records).collect()} == {
        ("g/e1", "ok"): 3, ("g/e1", "failed"): 1, ("g/e1", "skipped"): 1, ("g/e2", "failed"): 1}
    limited = inspection.filter_records(records, status="failed", model="M").filter("run_id = 'g/e1'")
    assert limited.first()["error_subkind"] == "network_connectivity"
    turns = execution.compile_expectations(joins.resolve_turns(
        cases.withColumn("expected_skills", F.col("expected"))))
    judged = joins.runs_with_case(runs, turns).withColumns({
        "expectations": F.lit(None).cast("array<struct<text: string, passed: boolean, evidence: string>>"),
        "dimensions": F.lit(None).cast("array<struct<dimension: string, score: double, evidence: string>>")})
    found = rows(evidence.full_failures(judged))
    assert [(r["case_id"], r["metric"]) for r in found] == [("none-rej-01", "task_completion")]
    assert "forbidden files: out/a.md" in found[0]["failure_detail"]
