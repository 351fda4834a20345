"""Full-execution metrics: did the run produce what the case turn asked for.

`score_turns` works row by row; everything after it aggregates scored turns
with the columns run_id, case_id, repeat_index, turn_index, line_no, type,
stage, severity, session_id, skipped, requires_context, ok, error_kind,
skill_injected, art_hits, art_total, tool_hits, tool_total, workspace_hits,
workspace_total, n_artifacts, done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import files
from evalgrain.functions.text import SYSTEM_KINDS
from evalgrain.operators import ordered
from evalgrain.operators.joins import CONVERSATION, RUN_KEY

METRICS = (
    "task_completion", "turn_completion", "artifact_hit", "tool_hit", "session_continuity",
    "context_retention", "file_state_continuity", "critical_miss",
)


def compile_expectations(turns: DataFrame) -> DataFrame:
    """Turn patterns into regexes and MIME types once per case turn, before the join with runs."""
    def patterns(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>"))

    return turns.withColumn(
        "artifact_rules", F.transform(patterns("expect_artifacts"), lambda p: F.struct(
            files.glob_regex(p).alias("regex"), files.guess_mime(p).alias("mime")))
    ).withColumn(
        "workspace_rules", F.transform(patterns("expect_workspace_files"), files.glob_regex)
    ).withColumn("tool_rules", patterns("expect_tools"))


def scored_part(runs: DataFrame) -> DataFrame:
    """Runs with no more of their artifacts and tool calls than scores and evidence read: joins move less."""
    def parts(name: str, fields: tuple[str, ...]) -> Column:
        return F.transform(name, lambda x: F.struct(*[x[f].alias(f) for f in fields]))

    return runs.withColumns({
        "artifacts": parts("artifacts", ("path", "size_bytes", "mime_type", "text_excerpt")),
        "tool_calls": parts("tool_calls", ("name",))})


def score_turns(rows: DataFrame) -> DataFrame:
    """Hits and totals per run turn, from runs joined with compiled expectations.

    Needs `catalog` (array of the skills the run could see) for the injection
    health check only.
    """
    artifacts = F.coalesce("artifacts", F.filter("artifacts", lambda a: F.lit(False)))
    tools = F.transform("tool_calls", lambda t: t["name"])
    art_hits = F.size(F.filter(
        "artifact_rules", lambda r: files.artifact_hit(r["regex"], r["mime"], artifacts)))
    tool_hits = F.size(F.filter("tool_rules", lambda t: F.coalesce(
        F.array_contains(tools, t), F.lit(False))))
    workspace_hits = F.size(F.filter("workspace_rules", lambda r: F.coalesce(
        files.workspace_hit(r, F.col("workspace_files")), F.lit(False))))
    n_artifacts = F.coalesce(F.array_size("artifacts"), F.lit(0))
    skipped = F.col("status") == "skipped"
    none = F.array().cast("array<string>")
    loaded = F.array_intersect(F.coalesce("loaded_skills", none), F.coalesce("catalog", none))
    facts = rows.select(
        *RUN_KEY, "line_no", "type", "stage", "severity", "session_id", "error_kind",
        F.coalesce(skipped, F.lit(False)).alias("skipped"),
        F.coalesce("requires_context", F.lit(False)).alias("requires_context"),
        (F.coalesce("ok", F.lit(True)) & ~F.coalesce(skipped, F.lit(False))).alias("ok"),
        (F.size(F.array_except(F.coalesce("expected_skills", none), loaded)) == 0)
        .alias("skill_injected"),
        art_hits.alias("art_hits"), F.size("artifact_rules").alias("art_total"),
        tool_hits.alias("tool_hits"), F.size("tool_rules").alias("tool_total"),
        workspace_hits.alias("workspace_hits"), F.size("workspace_rules").alias("workspace_total"),
        n_artifacts.alias("n_artifacts"),
        (F.coalesce("forbid_artifacts", F.lit(False)) & (n_artifacts > 0)).alias("_unclean"),
    )
    return facts.withColumn("done", is_done(~F.col("_unclean"))).drop("_unclean")


def is_done(clean: Column | None = None) -> Column:
    complete = F.col("ok") & (F.col("art_hits") == F.col("art_total")) \
        & (F.col("tool_hits") == F.col("tool_total")) \
        & (F.col("workspace_hits") == F.col("workspace_total"))
    return complete if clean is None else complete & clean


def conversations(turns: DataFrame) -> DataFrame:
    """One row per (case, repeat, occurrence); a repeated turn key opens another occurrence.

    Inside an occurrence every turn index is unique, so counting rows counts
    distinct turns.
    """
    ranked = ordered.positions(turns, RUN_KEY, "line_no", "_n")
    executed = ~F.col("skipped")
    session = F.when(executed & (F.col("session_id") != ""), F.col("session_id"))
    return ranked.withColumn("occurrence", F.col("_n") - 1).groupBy(*CONVERSATION, "occurrence").agg(
        F.bool_and("done").alias("done"),
        F.min_by("severity", F.struct("line_no", "turn_index")).alias("severity"),
        F.min_by("type", F.struct("line_no", "turn_index")).alias("type"),
        F.min_by("stage", F.struct("line_no", "turn_index")).alias("stage"),
        F.max("turn_index").alias("max_turn"),
        F.count(F.lit(1)).alias("turns"),
        F.max(F.when(executed, F.col("turn_index"))).alias("executed_max_turn"),
        F.count_if(executed).alias("executed_turns"),
        F.coalesce(F.min(session) == F.max(session), F.lit(False)).alias("one_session"),
    )


def conversation_scores(conversation: DataFrame) -> DataFrame:
    done = F.col("done").cast("double")
    whole = F.col("one_session") & (F.col("executed_turns") == F.col("executed_max_turn"))
    return conversation.groupBy("run_id").agg(
        F.avg(done).alias("task_completion"),
        F.avg(F.when(F.col("executed_turns") > 1, whole.cast("double"))).alias("session_continuity"),
        (1 - F.avg(F.when(F.col("severity") == "critical", done))).alias("critical_miss"),
    )


def turn_scores(turns: DataFrame) -> DataFrame:
    executed = turns.filter(~F.col("skipped"))
    done = F.col("done").cast("double")
    later = F.col("turn_index") > 1

    def ratio(hits: Column, total: Column) -> Column:
        whole = F.sum(total).cast("double")
        return F.when(whole > 0, F.sum(hits).cast("double") / whole)

    return executed.groupBy("run_id").agg(
        F.avg(done).alias("turn_completion"),
        ratio(F.col("art_hits"), F.col("art_total")).alias("artifact_hit"),
        ratio(F.col("tool_hits"), F.col("tool_total")).alias("tool_hit"),
        F.avg(F.when(F.col("requires_context"), done)).alias("context_retention"),
        ratio(F.when(later, F.col("workspace_hits")), F.when(later, F.col("workspace_total")))
        .alias("file_state_continuity"),
        F.avg(F.col("skill_injected").cast("double")).alias("skill_injected"),
    )


def scores(turns: DataFrame) -> DataFrame:
    """One wide row per run, from turns without system-failed conversations."""
    return conversation_scores(conversations(turns)).join(turn_scores(turns), "run_id", "left")


def case_repeats(turns: DataFrame) -> DataFrame:
    """One row per (case, repeat), the grain of reliability."""
    first = F.struct("line_no", "turn_index")
    return turns.groupBy(*CONVERSATION).agg(
        F.bool_and("done").alias("done"),
        F.min_by("type", first).alias("type"), F.min_by("stage", first).alias("stage"),
        F.min_by("severity", first).alias("severity"),
        F.max("turn_index").alias("turns"), F.min("line_no").alias("line_no"))


def completion_by(repeats: DataFrame, column: str) -> DataFrame:
    return repeats.groupBy("run_id", column).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("done").cast("double")).alias("completion"))


_HIT_SUMS = ("art_hits", "art_total", "tool_hits", "tool_total", "workspace_hits", "workspace_total")


def per_case(turns: DataFrame) -> DataFrame:
    whole = case_repeats(turns).groupBy("run_id", "case_id").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.avg(F.col("done").cast("double")).alias("done"), F.max("turns").alias("turns"))
    detail = turns.filter(~F.col("skipped")).groupBy("run_id", "case_id").agg(
        F.count(F.lit(1)).alias("turn_runs"),
        F.avg(F.col("done").cast("double")).alias("turn_completion"),
        F.avg(F.col("skill_injected").cast("double")).alias("injected"),
        *[F.sum(c).alias(c) for c in _HIT_SUMS],
        F.avg(F.col("n_artifacts").cast("double")).alias("files"))
    return whole.join(detail, ["run_id", "case_id"], "left")


def per_turn(turns: DataFrame) -> DataFrame:
    return turns.filter(~F.col("skipped")).groupBy("run_id", "case_id", "turn_index").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("done").cast("double")).alias("completion"),
        *[F.sum(c).alias(c) for c in _HIT_SUMS])


def run_counts(turns: DataFrame) -> DataFrame:
    """Counts over all turns, system failures included."""
    kinds = [f"{k}_failures" for k in SYSTEM_KINDS]
    per_conversation = turns.groupBy(*CONVERSATION).agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("skipped")).alias("skipped"),
        *[F.count_if(F.col("error_kind") == k).alias(c) for k, c in zip(SYSTEM_KINDS, kinds)])
    return per_conversation.groupBy("run_id").agg(
        F.count_distinct("case_id").alias("cases"), F.count(F.lit(1)).alias("conversations"),
        *[F.sum(c).alias(c) for c in ("turns", "skipped", *kinds)])


def skip_propagation(runs: DataFrame) -> DataFrame:
    """The status every turn should carry: after the first failed turn the rest is skipped.

    Input: run key, status. Adds expected_status and expected_reason, which name
    the failing turn.
    """
    failed = runs.filter(~F.col("status").isin("success", "skipped"))
    breaks = ordered.first_of(
        failed.withColumn("failed_turn", F.col("turn_index"))
        .withColumn("failed_status", F.col("status")),
        CONVERSATION, F.col("turn_index"), ["failed_turn", "failed_status"])
    after = F.col("turn_index") > F.col("failed_turn")
    return runs.join(breaks, CONVERSATION, "left").select(
        *runs.columns,
        F.when(after, F.lit("skipped")).otherwise(F.col("status")).alias("expected_status"),
        F.when(after, F.format_string(
            "turn %d came before and was %s", "failed_turn", "failed_status"))
        .alias("expected_reason"))
