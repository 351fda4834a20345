"""Table schemas as DDL text. NULL means not applicable or not recorded, never zero."""

from __future__ import annotations

from pyspark.sql.types import StructType

USAGE = (
    "struct<input_tokens: double, output_tokens: double, total_tokens: double, "
    "reasoning_tokens: double, tool_calls_total: double, tool_failures_total: double>"
)
EVENT = (
    "struct<step_index: int, event_type: string, name: string, tool_name: string, "
    "call_id: string, arguments: variant, result_summary: string, status: string, "
    "evidence_level: string, evidence_refs: array<string>, state_before: variant, "
    "state_after: variant, timestamp_ms: bigint, metadata: variant>"
)
TOOL_CALL = (
    "struct<name: string, count: int, failures: int, arguments: variant, result_summary: string>"
)
ARTIFACT = (
    "struct<path: string, sha256: string, size_bytes: bigint, mime_type: string, "
    "change: string, text_excerpt: string>"
)
ASSERTION = (
    "struct<tool: string, path: string, required: boolean, forbidden: boolean, "
    "equals: variant, `in`: array<variant>, matches: string>"
)
EXPECT_TRAJECTORY = (
    "struct<goal: string, required_tools: array<string>, forbidden_tools: array<string>, "
    "required_order: array<string>, required_state_change: boolean, "
    "required_verification: boolean, verification_tools: array<string>, "
    f"argument_assertions: array<{ASSERTION}>, assertions: array<string>>"
)
TURN = (
    "struct<prompt: string, files: array<string>, expect_artifacts: array<string>, "
    "expect_tools: array<string>, forbid_artifacts: boolean, expect_assertions: array<string>, "
    "reference: string, expect_workspace_files: array<string>, requires_context: boolean, "
    f"expect_trajectory: {EXPECT_TRAJECTORY}>"
)
CONTEXT = (
    "struct<role_prompt: string, long_context: string, "
    "messages: array<struct<role: string, content: string, name: string>>, "
    "tools: array<struct<name: string, description: string, source: string, server: string, "
    "input_schema: variant>>>"
)

RUNS = (
    "case_id string, repeat_index int, model string, request_id string, session_id string, "
    "turn_index int, status string, selected_skills array<string>, loaded_skills array<string>, "
    "reasoning string, final_answer string, raw_output string, error string, error_kind string, "
    "error_subkind string, skip_reason string, "
    f"tool_calls array<{TOOL_CALL}>, trajectory array<{EVENT}>, artifacts array<{ARTIFACT}>, "
    "workspace_files array<string>, runtime_name string, runtime_version string, "
    f"duration_ms bigint, usage {USAGE}, resolved_model string, ok boolean"
)
CASES = (
    f"id string, prompt string, context {CONTEXT}, expected_skills array<string>, "
    "tags array<string>, severity string, stage string, files array<string>, "
    "expect_artifacts array<string>, expect_tools array<string>, forbid_artifacts boolean, "
    "expect_assertions array<string>, reference string, expect_workspace_files array<string>, "
    f"requires_context boolean, expect_trajectory {EXPECT_TRAJECTORY}, turns array<{TURN}>"
)
GRADINGS = (
    "grader_version string, run_dir string, config_hash string, "
    "judge struct<id: string, model: string, api_base_env: string, api_key_env: string, "
    "params: variant, system_prompt_hash: string, dimensions: map<string,string>>, "
    "generated_at string, "
    "graded array<struct<case_id: string, repeat_index: int, turn_index: int, "
    "expectations: array<struct<text: string, passed: boolean, evidence: string>>, "
    "passed: int, failed: int, total: int, pass_rate: double, "
    "dimensions: array<struct<dimension: string, score: double, evidence: string>>, "
    "skipped_dimensions: array<string>>>, "
    "judge_failures array<struct<case_id: string, repeat_index: int, turn_index: int, "
    "error: string>>"
)
BOOLEAN_GOLD = (
    "schema_version string, calibration_id string, source_run string, annotated_by string, "
    "annotated_at string, annotations array<struct<case_id: string, assertion: string, "
    "passed: boolean, rationale: string>>"
)
SCORE_GOLD = (
    "schema_version string, calibration_id string, source_run string, annotated_by string, "
    "annotated_at string, dimension_versions map<string,string>, "
    "annotations array<struct<case_id: string, repeat_index: int, turn_index: int, "
    "dimension: string, score: double, rationale: string>>"
)
RUN_DIM = (
    "suite struct<suite_id: string, suite_version: string, dataset: string, runtime: string, "
    "repeats: int, parallelism: int, "
    "skills: struct<dir: string, target: array<string>, versions: map<string,string>, "
    "include: array<string>, exclude: array<string>, mode: string, cfg: string>, "
    "scoring: struct<metrics: array<string>, evaluators: array<string>, "
    "gate: map<string,string>, calibration_registry: string, "
    "judge: struct<id: string, model: string, api_base_env: string, params: variant, "
    "dimensions: array<string>>, "
    "trajectory: struct<enabled: boolean, mode: string, judge_id: string, "
    "dimensions: array<string>, version: string>>>, "
    "resolved_model struct<id: string, model: string>, config_hash string, dataset_hash string, "
    "skills map<string,string>, dataset_cases int, matrix_tasks int, conversations int, "
    "parallelism int, execution_id string, skill_catalog array<string>, "
    "skill_versions map<string,string>, started_at string, mock boolean"
)

# Enumerations of the run and event records.
RUN_STATUSES = ("success", "failed", "timeout", "denied", "budget_exceeded", "skipped")
ERROR_KINDS = ("task", "runtime", "network", "harness")
STAGES = ("trigger", "logic", "artifact", "failure")
CONTEXT_ROLES = ("system", "user", "assistant", "tool")
TOOL_SOURCES = ("builtin", "mcp")
SEVERITIES = ("low", "medium", "high", "critical")
EVENT_TYPES = (
    "observation", "tool_call", "tool_result", "state_change", "verification", "final",
    "error", "unknown",
)
EVIDENCE_LEVELS = ("exact", "coarse", "derived", "missing")
EVENT_STATUSES = ("started", "success", "failed", "skipped", "unknown")

# Rubric id → (inputs it needs, version).
RUBRICS = {
    "faithfulness": (("prompt", "output"), "v1"),
    "completeness": (("prompt", "output"), "v1"),
    "relevancy": (("prompt", "output"), "v1"),
    "instruction_following": (("prompt", "output"), "v1"),
    "correctness": (("prompt", "output", "reference"), "v1"),
    "conciseness": (("prompt", "output"), "v1"),
    "readability": (("prompt", "output"), "v1"),
}
TRAJECTORY_METRICS = (
    "tool_selection", "argument_correctness", "order_correctness", "state_persistence",
    "verification_rate",
)


def fields(ddl: str):
    """The fields of a schema; needs a running session."""
    return StructType.fromDDL(ddl).fields


def dimension_catalog(spark):
    rows = [(name, list(needs), version) for name, (needs, version) in RUBRICS.items()]
    return spark.createDataFrame(rows, "dimension string, requires array<string>, version string")
