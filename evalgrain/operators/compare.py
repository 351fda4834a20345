"""Comparison between runs: what differs in the setup, and what differs in the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions.text import content_hash
from evalgrain.schemas import RUBRICS, TRAJECTORY_METRICS

# Class of each configuration field, and defaults of old records.
FIELD_CLASSES = {
    "axis": ("suite_id", "skillcfg"),
    "derived": ("dataset", "dataset_hash", "n_skills"),
    "pollution": ("model", "runtime", "repeats", "parallelism"),
    "gauge": (
        "judge", "judge_model", "judge_prompt_hash", "judge_dimensions", "trajectory_judge",
        "trajectory_judge_model", "trajectory_judge_prompt_hash", "grading_hash",
        "evaluator_manifest",
    ),
}
FIELD_DEFAULTS = {"repeats": "3", "parallelism": "1"}
JUDGED_METRICS = ("assertion_pass_rate", "final_answer_quality", *TRAJECTORY_METRICS, *sorted(RUBRICS))


def config_diff(configs: DataFrame) -> DataFrame:
    """Fields whose values differ within a set of runs. Input: set_id, run_id, config fields."""
    classes = {f: c for c, fields in FIELD_CLASSES.items() for f in fields if f in configs.columns}
    wide = configs.select("set_id", "run_id", *[
        F.coalesce(F.col(f).cast("string"), F.lit(FIELD_DEFAULTS.get(f))).alias(f) for f in classes])
    long = wide.unpivot(["set_id", "run_id"], list(classes), "field", "setting")
    class_of = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    missing = F.count_if(F.col("setting").isNull())
    return long.groupBy("set_id", "field").agg(
        F.min("setting").alias("low"), F.max("setting").alias("high"), missing.alias("_missing"),
        F.count(F.lit(1)).alias("_n")) \
        .filter("low <> high OR (_missing > 0 AND _missing < _n)") \
        .select("set_id", "field", class_of[F.col("field")].alias("class"), "low", "high")


def metric_delta(scores: DataFrame, members: DataFrame) -> DataFrame:
    """Each run's metric next to the set's baseline; metrics nobody has are left out.

    `scores`: run_id, metric, value. `members`: set_id, run_id, baseline (the
    first run of the set).
    """
    own = members.join(scores.filter("value IS NOT NULL"), "run_id")
    base = members.select("set_id", F.col("baseline").alias("run_id")).distinct() \
        .join(scores, "run_id").select("set_id", "metric", F.col("value").alias("base_value"))
    known = own.select("set_id", "metric").distinct()
    grid = members.join(known, "set_id")
    return grid.join(own.select("set_id", "run_id", "metric", "value"),
                     ["set_id", "run_id", "metric"], "left") \
        .join(base, ["set_id", "metric"], "left") \
        .select("set_id", "run_id", "metric", "value", "base_value",
                (F.col("value") - F.col("base_value")).alias("delta"))


def judged_rows_flag(deltas: DataFrame, differences: DataFrame) -> DataFrame:
    """Add comparable: a judge-scored metric is not, once any gauge field differs in its set."""
    changed = differences.filter("class = 'gauge'").select("set_id", F.lit(True).alias("_g")).distinct()
    judged = F.col("metric").isin(*JUDGED_METRICS)
    return deltas.join(changed, "set_id", "left") \
        .withColumn("comparable", ~(judged & F.coalesce("_g", F.lit(False)))).drop("_g")


def efficiency_delta(efficiency: DataFrame, members: DataFrame) -> DataFrame:
    return metric_delta(efficiency.select("run_id", "metric", F.col("mean").alias("value")), members)


def same_execution_facts(members: DataFrame) -> DataFrame:
    """Per set: true when every run names its source hash and all hashes are equal."""
    source = F.when(F.col("source_runs_sha256") != "", F.col("source_runs_sha256"))
    return members.groupBy("set_id").agg(
        ((F.count(source) == F.count(F.lit(1)))
         & F.coalesce(F.min(source) == F.max(source), F.lit(False))).alias("same_facts"))


def run_summary(run_dim: DataFrame, verdicts: DataFrame, scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One flat row per run: setup, counts, live verdict and the chosen metrics."""
    wide = scores.groupBy("run_id").pivot("metric", metrics).agg(F.first("value"))
    return run_dim.join(verdicts, "run_id", "left").join(wide, "run_id", "left")


def grading_hash(source: list[Column], gauge: list[Column]) -> Column:
    """Two gradings with the same hash measured the same facts with the same gauge."""
    return content_hash(F.to_json(
        F.struct(F.struct(*source).alias("source"), F.struct(*gauge).alias("gauge")),
        {"ignoreNullFields": "false"}))
