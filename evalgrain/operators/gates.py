"""Release gates, the one place a verdict is derived, and failure diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalgrain.functions.cases import gate_condition
from evalgrain.functions.text import CASE_TYPES, SYSTEM_KINDS
from evalgrain.schemas import RUBRICS

# Category of a failure → what to do about it.
REMEDIATION = {
    "network_dns": "check name resolution and the configured API base URL, then check health again",
    "network_connectivity": "check the connection to the provider endpoint, then check health again",
    "network_timeout": "check provider availability and the timeout settings before a retry",
    "provider_authentication": "check the environment variable that holds the API key",
    "provider_quota_exhausted": "quota is used up; run the whole suite again with one other model",
    "provider_rate_limited": "wait for the provider's limit window or lower the request rate",
    "network": "check provider connectivity and credentials before a retry",
    "runtime": "read the runtime's health detail and repair the runtime before a retry",
    "harness": "read the recorded error: the evaluation system failed, not the skill",
    "task": "read the model output and the case: this failure counts",
    "unclassified": "read the recorded error before using the score",
}


def explode_gate(run_dim: DataFrame) -> DataFrame:
    """(run_id, metric, condition, op, threshold) from run_id and gate (map)."""
    rows = run_dim.select("run_id", F.explode("gate").alias("metric", "condition"))
    return rows.withColumn("_c", gate_condition(F.col("condition"))).select("*", "_c.*").drop("_c")


def gate_violations(gates: DataFrame) -> DataFrame:
    return gates.filter("op IS NULL")


def check_gate(gates: DataFrame, scores: DataFrame) -> DataFrame:
    """Add actual and pass; a metric without a value is skipped (pass NULL).

    NaN compares greater than everything in Spark, so it is treated as no value.
    """
    values = scores.select(
        "run_id", "metric", F.when(~F.isnan("value"), F.col("value")).alias("actual"))
    passed = F.when(F.col("op") == ">=", F.col("actual") >= F.col("threshold")) \
        .when(F.col("op") == "<=", F.col("actual") <= F.col("threshold"))
    return gates.join(values, ["run_id", "metric"], "left").withColumn("pass", passed)


def calibrated_outcome(checked: DataFrame) -> DataFrame:
    """Per run: false when a qualified gate row fails, NULL while one is unqualified, else true.

    Input of `check_gate` plus `unqualified` (boolean).
    """
    enforced = F.col("pass").isNotNull() & ~F.col("unqualified")
    outcome = (
        F.when(F.count_if(enforced & ~F.col("pass")) > 0, False)
        .when(F.count_if(F.col("unqualified")) > 0, F.lit(None).cast("boolean"))
        .when(F.count_if(enforced) > 0, True)
    )
    return checked.groupBy("run_id").agg(outcome.alias("observed_passed"))


def system_failure_counts(runs: DataFrame) -> DataFrame:
    """Runs and infrastructure failures per run_id, from the recorded kind only."""
    return runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("error_kind").isin(*SYSTEM_KINDS)).alias("n_system_failures"),
        *[F.count_if(F.col("error_kind") == k).alias(f"{k}_failures") for k in SYSTEM_KINDS])


def derive_verdict(facts: DataFrame) -> DataFrame:
    """Add quality_verdict, gate_pass, label and reason. Stored verdicts are not read.

    Input per run: n_runs, n_system_failures, observed_passed, mock.
    """
    n, broken = F.coalesce("n_runs", F.lit(0)), F.coalesce("n_system_failures", F.lit(0))
    verdict = (
        F.when(F.coalesce("mock", F.lit(False)), "not_evaluated")
        .when((n == 0) | (broken >= n) | F.col("observed_passed").isNull(), "indeterminate")
        .when(F.col("observed_passed"), "pass").otherwise("fail")
    )
    label = F.when(F.col("quality_verdict") == "not_evaluated", "NOT EVALUATED") \
        .otherwise(F.upper("quality_verdict"))
    reason = (
        F.when(F.col("quality_verdict") == "not_evaluated", "synthetic run")
        .when(n == 0, "no runs recorded")
        .when(broken >= n, "every run is an infrastructure failure")
        .when(F.col("observed_passed").isNull(), "no gate metric could be judged")
        .when(F.col("observed_passed"), "gate passed").otherwise("gate failed")
    )
    return facts.withColumn("quality_verdict", verdict) \
        .withColumn("gate_pass", F.when(F.col("quality_verdict").isin("pass", "fail"),
                                        F.col("observed_passed"))) \
        .withColumn("label", label).withColumn("reason", reason)


def failure_summary(runs: DataFrame) -> DataFrame:
    """Failed runs by category with the remedy: by subkind where a run has any, else by kind.

    One row per (run_id, level, category); `advised` marks the level whose
    remedies apply.
    """
    failed = runs.filter(~F.coalesce(F.col("ok"), F.lit(True)))
    kind = F.coalesce(F.when(F.col("error_kind") != "", F.col("error_kind")), F.lit("unclassified"))
    levels = F.explode(F.array(
        F.struct(F.lit("kind").alias("level"), kind.alias("category")),
        F.struct(F.lit("subkind").alias("level"),
                 F.when(F.col("error_subkind") != "", F.col("error_subkind")).alias("category"))))
    counted = failed.select("run_id", levels.alias("_l")).select("run_id", "_l.*") \
        .filter("category IS NOT NULL").groupBy("run_id", "level", "category") \
        .agg(F.count(F.lit(1)).alias("n"))
    has_subkind = counted.groupBy("run_id").agg(
        F.bool_or(F.col("level") == "subkind").alias("_sub"))
    actions = F.create_map(*[F.lit(x) for pair in REMEDIATION.items() for x in pair])
    action = F.coalesce(F.try_element_at(actions, F.col("category")), F.lit(REMEDIATION["unclassified"]))
    return counted.join(has_subkind, "run_id").select(
        "run_id", "level", "category", "n",
        (F.col("_sub") == (F.col("level") == "subkind")).alias("advised"), action.alias("action"))


def gate_coverage(gates: DataFrame, cases: DataFrame) -> DataFrame:
    """Gate metrics for which the run's case set holds no eligible case.

    `cases`: run_id, expected (array), severity, type.
    """
    size = F.size(F.coalesce("expected", F.array().cast("array<string>")))
    counts = {
        "top1": size == 1, "multi_exact": size > 1, "no_skill_rejection": size == 0,
        "false_activation": size == 0, "critical_miss": F.col("severity") == "critical",
        **{f"type_{t}": F.col("type") == t for t in CASE_TYPES},
    }
    eligible = cases.groupBy("run_id").agg(*[F.count_if(c).alias(m) for m, c in counts.items()])
    long = eligible.unpivot("run_id", list(counts), "metric", "eligible")
    return gates.join(long, ["run_id", "metric"]).filter("eligible = 0").select("run_id", "metric")


def merge_scalar_metrics(layers: DataFrame) -> DataFrame:
    """One value per (run_id, metric) from several evaluators; `conflict` marks different values.

    Input: run_id, evaluator, metric, value, exposed.
    """
    kept = layers.filter("exposed").withColumn("_known", F.col("value").isNotNull())
    return kept.groupBy("run_id", "metric").agg(
        F.min("value").alias("value"),
        ((F.count_if(F.col("_known")) > 0) & (F.count_if(~F.col("_known")) > 0)
         | (F.coalesce(F.min("value") != F.max("value"), F.lit(False)))).alias("conflict"))


def layer_report(outcome: DataFrame, trajectory: DataFrame, reliability: DataFrame,
                 efficiency: DataFrame) -> DataFrame:
    """The four layers in one long table; reliability and efficiency never reach a gate."""
    def layer(df: DataFrame, name: str, exposed: bool) -> DataFrame:
        return df.select("run_id", F.lit(name).alias("evaluator"), "metric",
                         F.col("value").cast("double").alias("value"),
                         F.lit(exposed).alias("exposed"))

    return layer(outcome, "outcome", True).unionByName(layer(trajectory, "trajectory", True)) \
        .unionByName(layer(reliability, "reliability", False)) \
        .unionByName(layer(efficiency, "efficiency", False))


def outcome_layer(scores: DataFrame) -> DataFrame:
    """task_completion, artifact_correctness and final_answer_quality from long scores."""
    def value(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    wide = scores.groupBy("run_id").agg(
        value("task_completion").alias("task_completion"),
        value("artifact_hit").alias("artifact_correctness"),
        F.avg(F.when(F.col("metric").isin(*RUBRICS), F.col("value"))).alias("final_answer_quality"))
    return wide.unpivot(
        "run_id", ["task_completion", "artifact_correctness", "final_answer_quality"],
        "metric", "value")
