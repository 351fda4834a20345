"""Statistics across repeats, reliability and cost. N/A is NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import usage
from evalgrain.operators import ordered

EFFICIENCY = ("time_seconds", "tokens", "tool_calls", "errors")


def stats_columns(value: Column) -> list[Column]:
    """mean, stddev (sample; 0 for a single value), min, max over non-NULL values."""
    return [
        F.avg(value).alias("mean"),
        F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias("stddev"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]


def stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(*stats_columns(F.col(value).cast("double")))


def stability(rows: DataFrame, flag: str) -> DataFrame:
    """Spread of a run's per-repeat rates."""
    per_repeat = rows.groupBy("run_id", "repeat_index") \
        .agg(F.avg(F.col(flag).cast("double")).alias("rate"))
    return per_repeat.groupBy("run_id").agg(*stats_columns(F.col("rate")))


def repeat_outcomes(rows: DataFrame, flag: str) -> DataFrame:
    """Per case: distinct repeats and whether any / all succeeded. The last row of a repeat counts."""
    last = ordered.last_of(
        rows, ["run_id", "case_id", "repeat_index"], F.col("line_no"), [flag])
    return last.groupBy("run_id", "case_id").agg(
        F.count(F.lit(1)).alias("repeats"),
        F.bool_or(flag).alias("any_passed"), F.bool_and(flag).alias("all_passed"))


def pass_rates(rows: DataFrame, flag: str, k: int | Column) -> DataFrame:
    """pass_at_k and pass_all_k over cases with exactly k repeats; NULL when there are none."""
    complete = F.col("repeats") == (F.lit(k) if isinstance(k, int) else k)
    return repeat_outcomes(rows, flag).groupBy("run_id").agg(
        F.count_if(complete).alias("complete_cases"),
        F.avg(F.when(complete, F.col("any_passed").cast("double"))).alias("pass_at_k"),
        F.avg(F.when(complete, F.col("all_passed").cast("double"))).alias("pass_all_k"))


def efficiency_values(runs: DataFrame, include_skipped: bool = True) -> DataFrame:
    """(run_id, metric, value) per run turn, from duration_ms, usage, tool_calls, error_kind."""
    kept = runs if include_skipped else runs.filter(
        F.coalesce(F.col("status") != "skipped", F.lit(True)))
    wide = kept.select(
        "run_id",
        (F.col("duration_ms").cast("double") / 1000).alias("time_seconds"),
        usage.tokens(F.col("usage")).alias("tokens"),
        usage.tool_call_count(F.col("usage"), F.col("tool_calls")).alias("tool_calls"),
        F.when(F.coalesce("error_kind", F.lit("")) != "", 1.0).otherwise(0.0).alias("errors"))
    return wide


def efficiency(runs: DataFrame, include_skipped: bool = True) -> DataFrame:
    """Statistics of seconds, tokens, tool calls and errors: one pass, then one row per metric."""
    wide = efficiency_values(runs, include_skipped)
    summary = wide.groupBy("run_id").agg(*[
        F.struct(*stats_columns(F.col(m)), F.count(m).alias("n")).alias(m) for m in EFFICIENCY])
    return summary.unpivot("run_id", list(EFFICIENCY), "metric", "s").select("run_id", "metric", "s.*")


def flaky_cases(rows: DataFrame, flag: str) -> DataFrame:
    """Cases whose rows disagree."""
    return rows.groupBy("run_id", "case_id").agg(
        F.count_if(F.col(flag)).alias("passed"), F.count(F.lit(1)).alias("runs"),
    ).filter("passed > 0 AND passed < runs").withColumn(
        "pass_rate", F.col("passed") / F.col("runs"))


def non_discriminating(rates: DataFrame, pairs: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Cases at or above the threshold in both runs of a pair.

    `rates`: run_id, case_id, rate. `pairs`: baseline, treatment.
    """
    high = rates.filter(F.col("rate") >= threshold).select("run_id", "case_id")
    left = pairs.join(high.withColumnRenamed("run_id", "baseline"), "baseline")
    return left.join(
        high.withColumnRenamed("run_id", "treatment"), ["treatment", "case_id"], "left_semi")


def reliability(rows: DataFrame) -> DataFrame:
    """repeat_pass_rate, variance (a standard deviation) and flaky_rate per run, at row grain."""
    per_repeat = rows.filter(~F.col("skipped")).groupBy("run_id", "repeat_index") \
        .agg(F.avg(F.col("done").cast("double")).alias("rate"))
    spread = per_repeat.groupBy("run_id").agg(
        F.avg("rate").alias("repeat_pass_rate"),
        F.when(F.count("rate") == 1, F.lit(0.0)).otherwise(F.stddev_samp("rate")).alias("variance"))
    per_case = rows.groupBy("run_id", "case_id").agg(
        F.count_if(F.col("done")).alias("p"), F.count(F.lit(1)).alias("n"))
    flaky = per_case.groupBy("run_id").agg(
        F.avg(((F.col("p") > 0) & (F.col("p") < F.col("n"))).cast("double")).alias("flaky_rate"))
    return flaky.join(spread, "run_id", "left") \
        .select("run_id", "repeat_pass_rate", "variance", "flaky_rate")


def run_usage(runs: DataFrame) -> DataFrame:
    """Totals of a run and how many of its rows report no tokens or no duration."""
    tokens = usage.tokens(F.col("usage"))
    return runs.groupBy("run_id").agg(
        F.coalesce(F.sum(tokens), F.lit(0.0)).cast("bigint").alias("total_tokens"),
        (F.coalesce(F.sum("duration_ms"), F.lit(0)) / 1000).alias("total_seconds"),
        F.count(F.lit(1)).alias("runs"),
        F.count_if(tokens.isNull()).alias("runs_missing_tokens"),
        F.count_if(F.col("duration_ms").isNull()).alias("runs_missing_duration"))


def cumulative_usage(lineage: DataFrame) -> DataFrame:
    """Running totals over the iterations of a lineage.

    Input: lineage_id, iteration (BIGINT), run_id, the columns of `run_usage`,
    max_total_tokens, max_total_seconds. `usable` is false when a configured
    limit cannot be judged because telemetry is missing up to that iteration.
    """
    sums = ("total_tokens", "total_seconds", "runs", "runs_missing_tokens", "runs_missing_duration")
    running = ordered.running_totals(
        lineage, ["lineage_id"], "iteration", {f"cum_{c}": F.col(c) for c in sums})
    blind = (F.col("max_total_tokens").isNotNull() & (F.col("cum_runs_missing_tokens") > 0)) \
        | (F.col("max_total_seconds").isNotNull() & (F.col("cum_runs_missing_duration") > 0))
    return running.withColumn("usable", ~blind)


def duplicate_lineage_runs(lineage: DataFrame) -> DataFrame:
    return lineage.groupBy("lineage_id", "run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def stop_decision(usage_rows: DataFrame) -> DataFrame:
    """Triggered stop reasons in order of priority, and the primary one.

    Input adds gate_pass and max_iterations to `cumulative_usage`.
    """
    spent = (F.col("cum_total_tokens") >= F.col("max_total_tokens"))
    slow = (F.col("cum_total_seconds") >= F.col("max_total_seconds"))
    budget = F.coalesce(spent, F.lit(False)) | F.coalesce(slow, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("gate_pass"), F.lit("gate_pass")),
        F.when(budget, F.lit("budget_exceeded")),
        F.when(F.col("iteration") >= F.col("max_iterations"), F.lit("max_iterations"))))
    return usage_rows.withColumn("triggered", reasons) \
        .withColumn("stop_reason", F.try_element_at(F.col("triggered"), F.lit(1)))


def iteration_policy(lineage: DataFrame) -> DataFrame:
    """Violations inside a lineage: a jump in the iteration number or changed limits."""
    fixed = ["max_iterations", "max_total_tokens", "max_total_seconds"]
    rows = ordered.with_previous(lineage, ["lineage_id"], "iteration", ["iteration", *fixed]) \
        .filter("position > 1")
    changed = F.lit(False)
    for c in fixed:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"previous_{c}"))
    jump = F.col("iteration") != F.col("previous_iteration") + 1
    return rows.filter(jump | changed).select(
        "lineage_id", "iteration", jump.alias("iteration_jump"), changed.alias("limits_changed"))


def semantic_mean(scores: DataFrame, dimensions: list[str] | tuple[str, ...]) -> DataFrame:
    """final_answer_quality: mean of the semantic dimensions a run has. Input: run_id, metric, value."""
    return scores.filter(F.col("metric").isin(*dimensions)).groupBy("run_id") \
        .agg(F.avg("value").alias("final_answer_quality"))
