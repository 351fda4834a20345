"""Judge calibration against human labels, and which gate metrics a judge may decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions.cases import sorted_map
from evalgrain.operators import joins, ordered
from evalgrain.schemas import RUBRICS, TRAJECTORY_METRICS

# The floors of the registry policy.
AGREEMENT_MIN = 0.80
INVALID_MAX = 0.02
TOLERANCE_MAX = 0.25
ANNOTATIONS_MIN = 10

JUDGE = ["calibration_id", "judge_id"]
ASSERTION = ["case_id", "assertion"]
SCORE = ["case_id", "repeat_index", "turn_index", "dimension"]


def assertion_pairs(gold: DataFrame, judged: DataFrame) -> DataFrame:
    """Human and judge verdict side by side. `judged` also carries judge_id."""
    human = gold.select(
        "calibration_id", *ASSERTION, F.col("passed").alias("human_passed"),
        F.col("rationale").alias("human_rationale"))
    machine = judged.select(
        *JUDGE, *ASSERTION, F.col("passed").alias("judge_passed"),
        F.coalesce("evidence", F.lit("")).alias("judge_evidence"))
    return machine.join(human, ["calibration_id", *ASSERTION])


def assertion_agreement(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*JUDGE).agg(
        F.count(F.lit(1)).alias("n_annotations"),
        F.avg((F.col("human_passed") == F.col("judge_passed")).cast("double")).alias("agreement"))


def assertion_disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter("human_passed <> judge_passed")


def invalid_output_rate(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Failed over attempted judge calls; no attempt counts as 0. `calls`: keys, failed (boolean)."""
    return calls.groupBy(*keys).agg(
        F.count_if(F.col("failed")).alias("invalid_outputs"),
        F.count("failed").alias("attempted_calls"),
        F.coalesce(F.try_divide(F.count_if(F.col("failed")).cast("double"),
                                F.count("failed").cast("double")), F.lit(0.0))
        .alias("invalid_output_rate"))


def gold_coverage(gold: DataFrame, judged: DataFrame, keys: list[str],
                  failures: DataFrame | None = None, failure_keys: list[str] | None = None) -> DataFrame:
    return joins.coverage(gold, judged, keys, failures, failure_keys)


def dimension_agreement(gold: DataFrame, judged: DataFrame, tolerance: float = TOLERANCE_MAX
                        ) -> DataFrame:
    """Per judge and dimension: annotations, valid scores, agreement, mean absolute error.

    `gold`: calibration_id, judge_id (who was asked), SCORE columns, score.
    """
    machine = judged.select(*JUDGE, *SCORE, F.col("score").alias("judge_score"))
    error = F.abs(F.col("judge_score") - F.col("score"))
    return gold.join(machine, [*JUDGE, *SCORE], "left").groupBy(*JUDGE, "dimension").agg(
        F.count(F.lit(1)).alias("n_annotations"), F.count("judge_score").alias("n_valid"),
        F.coalesce(F.avg((error <= tolerance).cast("double")), F.lit(0.0)).alias("agreement"),
        F.avg(error).alias("mean_absolute_error"))


def dimension_invalid_rate(gold: DataFrame, failures: DataFrame) -> DataFrame:
    """Distinct failed calls over distinct attempted calls, per judge and dimension."""
    call = ["case_id", "repeat_index", "turn_index"]
    failed = failures.select(*JUDGE, *call, F.lit(True).alias("_failed")).distinct()
    return gold.select(*JUDGE, "dimension", *call).distinct() \
        .join(failed, [*JUDGE, *call], "left").groupBy(*JUDGE, "dimension").agg(
            F.count("_failed").alias("invalid_outputs"),
            F.count(F.lit(1)).alias("attempted_calls"),
            (F.count("_failed").cast("double") / F.count(F.lit(1))).alias("invalid_output_rate"))


def assertion_qualified(agreement: Column, invalid_rate: Column) -> Column:
    return (agreement >= AGREEMENT_MIN) & (invalid_rate <= INVALID_MAX)


def dimension_qualified(agreement: Column, invalid_rate: Column, annotations: Column, valid: Column
                        ) -> Column:
    return (annotations >= ANNOTATIONS_MIN) & (valid > 0) \
        & assertion_qualified(agreement, invalid_rate)


def rubric_version_mismatch(gold_versions: DataFrame, judge_versions: DataFrame) -> DataFrame:
    """Dimensions whose judge used another rubric version than the human gold.

    `gold_versions`: calibration_id, judge_id, dimension, version; `judge_versions`
    the same.
    """
    machine = judge_versions.withColumnRenamed("version", "judge_version")
    return gold_versions.join(machine, [*JUDGE, "dimension"], "left") \
        .filter(~F.col("version").eqNullSafe(F.col("judge_version")))


def policy_violations(reports: DataFrame) -> DataFrame:
    """Qualified records whose report used looser thresholds than the policy allows.

    Input: scope, qualified, agreement_min, invalid_max, tolerance,
    annotations_min, n_annotations.
    """
    loose = (F.coalesce("agreement_min", F.lit(-1.0)) < AGREEMENT_MIN) \
        | (F.coalesce("invalid_max", F.lit(2.0)) > INVALID_MAX)
    standard = F.col("scope") == "standard_dimension"
    loose_dimension = (F.coalesce("tolerance", F.lit(2.0)) > TOLERANCE_MAX) \
        | (F.coalesce("annotations_min", F.lit(0)) < ANNOTATIONS_MIN)
    few = F.coalesce("n_annotations", F.lit(0)) < ANNOTATIONS_MIN
    problem = F.when(loose, "thresholds below policy") \
        .when(standard & loose_dimension, "dimension policy too loose") \
        .when(standard & few, "too few annotations")
    return reports.filter("qualified").withColumn("problem", problem).filter("problem IS NOT NULL")


def fingerprint(judge: Column) -> Column:
    """Canonical text of a judge gauge; NULL when it is incomplete. The id is no part of it."""
    required = ["model", "api_base_env", "system_prompt_hash"]
    complete = F.lit(True)
    for name in required:
        complete = complete & F.coalesce(judge[name] != "", F.lit(False))
    return F.when(complete, F.to_json(F.struct(
        *[judge[name].alias(name) for name in required],
        sorted_map(judge["params"]).alias("params"),
        sorted_map(judge["dimensions"]).alias("dimensions"))))


def registry_best(records: DataFrame) -> DataFrame:
    """One record per gauge: highest agreement, then lowest invalid rate, then first in the report.

    Input: scope, dimension, fingerprint, agreement, invalid_output_rate,
    position, and further columns.
    """
    keys = ["scope", "dimension", "fingerprint"]
    rest = [c for c in records.columns if c not in keys]
    order = F.struct(-F.col("agreement"), F.col("invalid_output_rate"), F.col("position"))
    return ordered.first_of(
        records.withColumn("dimension", F.coalesce("dimension", F.lit(""))), keys, order, rest) \
        .withColumn("dimension", F.nullif(F.col("dimension"), F.lit("")))


def registry_violations(entries: DataFrame, evidence: DataFrame, reports: DataFrame) -> DataFrame:
    """Registry entries that repeat an id or gauge, or differ from the evidence they cite.

    `entries`: entry_id, calibration_id, scope, dimension, fingerprint,
    evidence_judge_id, agreement, invalid_output_rate, agreement_tolerance,
    mean_absolute_error, qualified, evidence_report, report_hash. `evidence`: the
    records of the reports with their report path; `reports`: evidence_report,
    actual_hash, report_calibration_id.
    """
    values = ["agreement", "invalid_output_rate", "agreement_tolerance", "mean_absolute_error",
              "qualified"]
    cited = evidence.select(
        "evidence_report", F.col("judge_id").alias("evidence_judge_id"), "fingerprint",
        F.coalesce("dimension", F.lit("")).alias("_dimension"),
        *[F.col(v).alias(f"_{v}") for v in values])
    by_dimension = F.when(F.col("scope") == "absolute_assertions", F.lit("")) \
        .otherwise(F.coalesce("dimension", F.lit("")))
    on = ["evidence_report", "evidence_judge_id", "fingerprint", "_dimension"]
    matched = entries.withColumn("_dimension", by_dimension).join(cited, on, "left")
    equal = F.lit(True)
    for v in values:
        same = F.col(v).eqNullSafe(F.col(f"_{v}"))
        only_dimensions = v in ("agreement_tolerance", "mean_absolute_error")
        equal = equal & ((F.col("scope") == "absolute_assertions") | same if only_dimensions else same)
    found = F.col("_agreement").isNotNull()
    per_entry = matched.groupBy("entry_id", "fingerprint", "evidence_report").agg(
        F.count_if(found).alias("matches"),
        F.coalesce(F.bool_and(equal), F.lit(False)).alias("_equal"))
    content = per_entry.select("entry_id", F.when(F.col("matches") != 1, "evidence not unique")
                               .when(~F.col("_equal"), "values differ from evidence").alias("problem"))
    reported = entries.join(reports, "evidence_report", "left").select(
        "entry_id",
        F.when(F.col("actual_hash").isNull(), "report missing")
        .when(F.col("actual_hash") != F.col("report_hash"), "report hash differs")
        .when(~F.col("report_calibration_id").eqNullSafe(F.col("calibration_id")),
              "calibration id differs").alias("problem"))
    ids = joins.duplicate_keys(entries, ["entry_id"]) \
        .select("entry_id", F.lit("entry id repeated").alias("problem"))
    gauges = joins.duplicate_keys(entries, ["scope", "dimension", "fingerprint"])
    repeated = entries.join(
        gauges.select("scope", "fingerprint", F.coalesce("dimension", F.lit("")).alias("_dimension")),
        (entries["scope"] == gauges["scope"]) & (entries["fingerprint"] == gauges["fingerprint"])
        & (F.coalesce(entries["dimension"], F.lit("")) == F.col("_dimension")), "left_semi") \
        .select("entry_id", F.lit("gauge registered twice").alias("problem"))
    return content.unionByName(reported).unionByName(ids).unionByName(repeated) \
        .filter("problem IS NOT NULL")


def gate_calibration_scope(gates: DataFrame, deterministic: DataFrame) -> DataFrame:
    """Add scope and dimension: which calibration a gate metric needs; NULL when code decides it.

    `gates`: run_id, metric. `deterministic`: run_id, metric proven by code.
    """
    proven = deterministic.select("run_id", "metric", F.lit(True).alias("_proven"))
    semantic = F.col("metric").isin(*RUBRICS, "final_answer_quality")
    scope = (
        F.when(F.col("metric") == "assertion_pass_rate", "absolute_assertions")
        .when(semantic, "standard_dimension")
        .when(F.col("metric").isin(*TRAJECTORY_METRICS) & F.col("_proven").isNull(),
              "trajectory_dimension")
    )
    return gates.join(proven, ["run_id", "metric"], "left") \
        .withColumn("scope", scope).drop("_proven") \
        .withColumn("dimension", F.when(
            F.col("scope").isin("standard_dimension", "trajectory_dimension"), F.col("metric")))


def registry_match(scoped: DataFrame, judges: DataFrame, registry: DataFrame) -> DataFrame:
    """Each gate metric that needs calibration with the registry entry of its judge, if any.

    `judges`: run_id, scope_kind (output, trajectory), fingerprint. `registry`:
    entry_id, scope, dimension, fingerprint, qualified.
    """
    need = scoped.filter("scope IS NOT NULL").withColumn(
        "scope_kind",
        F.when(F.col("scope") == "trajectory_dimension", "trajectory").otherwise("output"))
    asked = need.join(judges, ["run_id", "scope_kind"], "left") \
        .withColumn("_dimension", F.coalesce("dimension", F.lit("")))
    known = registry.select(
        "scope", "fingerprint", F.coalesce("dimension", F.lit("")).alias("_dimension"),
        "entry_id", "qualified")
    return asked.join(known, ["scope", "fingerprint", "_dimension"], "left").drop("_dimension")


def gate_calibration(matched: DataFrame, has_registry: Column) -> DataFrame:
    """Add qualified and one of four reasons."""
    qualified = F.coalesce("qualified", F.lit(False))
    reason = (
        F.when(qualified, "qualified")
        .when(~has_registry, "no registry of calibrations")
        .when(F.col("entry_id").isNull(), "setup is not in the registry")
        .otherwise("registered, below its thresholds")
    )
    return matched.withColumn("reason", reason).withColumn("qualified", qualified)
