"""Flat records for looking into runs, and planning counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions.text import error_subkind, non_empty
from evalgrain.operators import joins


def inspect_records(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """One flat record per run turn. Old rows get their missing error_subkind from the error text."""
    key = joins.case_key(runs, cases, ["case_id"])
    gold = cases.select(*key, "prompt", "expected_skills")
    none = F.array().cast("array<string>")
    status = F.when(F.col("status") == "skipped", "skipped") \
        .when(F.coalesce("ok", F.lit(True)), "ok").otherwise("failed")
    subkind = F.coalesce(non_empty(F.col("error_subkind")),
                         error_subkind(F.col("error_kind"), non_empty(F.col("error"))))
    return runs.join(gold, key, "left").select(
        "run_id", "case_id", F.coalesce("turn_index", F.lit(1)).alias("turn_index"),
        F.coalesce("repeat_index", F.lit(0)).alias("repeat_index"), status.alias("status"),
        F.coalesce(non_empty(F.col("resolved_model")), F.col("model")).alias("model"),
        "session_id", "prompt", F.coalesce("expected_skills", none).alias("expected_skills"),
        F.coalesce("selected_skills", none).alias("selected_skills"),
        F.coalesce("loaded_skills", none).alias("loaded_skills"),
        F.filter(F.transform("tool_calls", lambda t: t["name"]), lambda n: n != "").alias("tools"),
        F.filter(F.transform("artifacts", lambda a: a["path"]), lambda p: p != "").alias("artifacts"),
        "final_answer", "reasoning", "error_kind", subkind.alias("error_subkind"), "error")


def filter_records(
    records: DataFrame, case_id: str | None = None, turn: int | None = None,
    repeat: int | None = None, status: str | None = None, skill: str | None = None,
    model: str | None = None,
) -> DataFrame:
    conditions: list[Column] = []
    if case_id:
        conditions.append(F.col("case_id") == case_id)
    if turn is not None:
        conditions.append(F.col("turn_index") == turn)
    if repeat is not None:
        conditions.append(F.col("repeat_index") == repeat)
    if status:
        conditions.append(F.col("status") == status)
    if model:
        conditions.append(F.lower(F.coalesce("model", F.lit(""))).contains(model.lower()))
    if skill:
        conditions.append(
            F.array_contains("expected_skills", skill) | F.array_contains("selected_skills", skill)
            | F.array_contains("loaded_skills", skill))
    for condition in conditions:
        records = records.filter(condition)
    return records


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def observed_models(records: DataFrame) -> DataFrame:
    return records.filter("model IS NOT NULL").select("run_id", "model").distinct()


def inspection_summary(records: DataFrame, verdicts: DataFrame, archived: DataFrame) -> DataFrame:
    """Counts per run with the live verdict next to the archived one.

    `archived`: run_id, historical_quality_verdict, historical_gate_pass; it is
    shown, never used.
    """
    counts = records.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("ok", "failed", "skipped")])
    return counts.join(
        verdicts.select("run_id", "quality_verdict", "gate_pass", "label", "reason"), "run_id", "left") \
        .join(archived, "run_id", "left")


def work_estimate(cases: DataFrame, models: list[str], repeats: int) -> DataFrame:
    """Cases, turns and requests a suite would cost. `cases`: set_id, turn_count."""
    turns = F.sum("turn_count")
    return cases.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("cases"), turns.alias("turns"),
        (turns * repeats).alias("tasks_per_model"),
        (turns * repeats * len(models)).alias("planned_requests"))
