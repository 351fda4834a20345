"""End-to-end reports over a lake of runs: scores, gates and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalgrain.functions import cases as case_functions
from evalgrain.functions.text import case_type
from evalgrain.operators import execution, gates, joins, routing, stats


def routing_rows(runs: DataFrame, cases: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Run rows with what their case expects; case fields are derived on the case side.

    The key is `on`, else the case id, with `dataset_hash` where both tables carry it (`joins.with_dataset`).
    """
    on = on or joins.case_key(runs, cases, ["case_id"])
    none = F.array().cast("array<string>")

    def claimed(column: str):
        return F.size(F.coalesce(column, none)) > 0 if column in cases.columns else F.lit(False)

    forbids = F.coalesce("forbid_artifacts", F.lit(False)) if "forbid_artifacts" in cases.columns \
        else F.lit(False)
    traces = F.col("expect_trajectory").isNotNull() if "expect_trajectory" in cases.columns \
        else F.lit(False)
    gold = routing.with_gold(cases).select(
        *on, "expected", "expected_set", "n_expected", "truth", "severity", case_type(F.col("case_id")).alias("type"),
        case_functions.case_stage(
            F.col("stage"), F.coalesce("tags", none), claimed("expect_artifacts") | forbids,
            claimed("expect_tools") | traces).alias("stage"))
    facts = runs.select("run_id", "case_id", "repeat_index", "line_no", "selected", "ok", "error_kind",
                        *[c for c in on if c != "case_id"])
    return joins.runs_with_case(facts, gold, on)


def case_table(cases: DataFrame) -> DataFrame:
    """Cases as `sources.cases.read_cases` gives them, under the names the reports use."""
    return cases.withColumnsRenamed({"id": "case_id", "expected_skills": "expected"})


def execution_turns(runs: DataFrame, cases: DataFrame, run_dim: DataFrame) -> DataFrame:
    """Scored turns from run records, cases (`case_table`) and run snapshots.

    Runs are joined with small per-turn expectations; the skill catalog of a
    run comes from its snapshot. Cases of several datasets carry `dataset_hash`;
    that of a run comes from its snapshot too.
    """
    if "dataset_hash" in cases.columns and "dataset_hash" not in runs.columns:
        runs = joins.with_dataset(runs, run_dim)
    key = joins.case_key(runs, cases, ["case_id", "turn_index"])
    none = F.array().cast("array<string>")
    stage = case_functions.case_stage(
        F.col("stage"), F.coalesce("tags", none),
        (F.size("expect_artifacts") > 0) | F.col("forbid_artifacts"),
        (F.size("expect_tools") > 0) | F.col("expect_trajectory").isNotNull())
    described = cases.withColumns({
        "type": case_type(F.col("case_id")), "stage": stage, "expected_skills": F.col("expected")})
    expectations = execution.compile_expectations(joins.resolve_turns(described)).select(
        *key, "type", "stage", "severity", "expected_skills", "forbid_artifacts",
        "requires_context", "artifact_rules", "workspace_rules", "tool_rules")
    catalogs = run_dim.select("run_id", F.col("skill_catalog").alias("catalog"))
    rows = joins.runs_with_case(execution.scored_part(runs), expectations).join(catalogs, "run_id", "left")
    return execution.score_turns(rows)


def routing_scores(rows: DataFrame, repeats: int = 3) -> DataFrame:
    """(run_id, metric, value): every routing metric and the reliability pair."""
    judged = routing.judge(rows)
    wide = routing.scores(judged)
    reliability = stats.pass_rates(judged, "exact", repeats)
    return routing.long_scores(wide, routing.METRICS).unionByName(
        routing.long_scores(reliability, ["pass_at_k", "pass_all_k"]))


def execution_scores(turns: DataFrame, repeats: int = 1) -> DataFrame:
    """(run_id, metric, value) of full-execution runs; system-failed conversations are left out."""
    kept = joins.drop_system_conversations(turns)
    wide = execution.scores(kept)
    reliability = stats.pass_rates(execution.case_repeats(kept), "done", repeats)
    return routing.long_scores(wide, execution.METRICS).unionByName(
        routing.long_scores(reliability, ["pass_at_k", "pass_all_k"]))


def verdicts(run_dim: DataFrame, runs: DataFrame, scores: DataFrame,
             calibration: DataFrame | None = None) -> DataFrame:
    """One verdict per run of `run_dim`, also for runs without a single row.

    `run_dim`: run_id, gate (map), mock. `calibration`: run_id, metric,
    qualified for the metrics a judge decides.
    """
    checked = gates.check_gate(gates.explode_gate(run_dim), scores)
    if calibration is None:
        checked = checked.withColumn("unqualified", F.lit(False))
    else:
        weak = calibration.filter("NOT qualified").select(
            "run_id", "metric", F.lit(True).alias("unqualified"))
        checked = checked.join(weak, ["run_id", "metric"], "left") \
            .withColumn("unqualified", F.coalesce("unqualified", F.lit(False)))
    outcome = gates.calibrated_outcome(checked)
    counts = gates.system_failure_counts(runs)
    facts = run_dim.select("run_id", "mock").join(counts, "run_id", "left") \
        .join(outcome, "run_id", "left")
    return gates.derive_verdict(facts)
