"""Failure evidence, and checks of suggestions made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import files
from evalgrain.functions.text import SYSTEM_KINDS, non_empty, quotable
from evalgrain.operators import joins
from evalgrain.operators.joins import RUN_KEY

# Fixed values.
LOW_DIMENSION = 0.6


def _own_fault() -> Column:
    return F.coalesce(~F.col("error_kind").isin(*SYSTEM_KINDS), F.lit(True))


def routing_failures(rows: DataFrame) -> DataFrame:
    """Runs that failed as a task or chose other skills than expected, order included."""
    none = F.array().cast("array<string>")
    expected, selected = F.coalesce("expected", none), F.coalesce("selected", none)
    wrong = ~F.coalesce("ok", F.lit(True)) | (expected != selected)
    raw = F.coalesce(*[non_empty(F.col(c)) for c in ("raw_output", "reasoning", "error")], F.lit(""))
    return rows.filter(_own_fault() & wrong).select(
        "run_id", "case_id", "repeat_index", F.lit("exact_set_match").alias("metric"),
        expected.alias("expected"), selected.alias("selected"), raw.alias("raw_output"))


def grading_facts(gradings: DataFrame) -> DataFrame:
    """Gradings with the assertions and dimensions that failed; `soft`: there are any."""
    failed = F.coalesce(F.filter("expectations", lambda e: ~F.coalesce(e["passed"], F.lit(False))),
                        F.filter("expectations", lambda e: F.lit(False)))
    low = F.filter("dimensions", lambda d: F.coalesce(d["score"], F.lit(0.0)) < LOW_DIMENSION)
    return gradings.withColumns({"failed_assertions": failed, "low_dimensions": low}).withColumn(
        "soft", (F.coalesce(F.size("failed_assertions"), F.lit(0)) > 0)
        | (F.coalesce(F.size("low_dimensions"), F.lit(0)) > 0))


def full_failures(rows: DataFrame, gradings: DataFrame | None = None, on: list[str] = RUN_KEY) -> DataFrame:
    """At most one row per run turn, saying what is missing; texts are whole.

    Input: runs joined with compiled expectations (`execution.compile_expectations`).
    The chosen judge's grading (`expectations`, `dimensions`; NULL when there is
    none) stands in the rows, or in `gradings`, at most one per `on`: then each
    side is judged before they are joined, and the join moves verdicts only.
    """
    kept = rows.filter(_own_fault() & (F.col("status") != "skipped"))
    artifacts = F.coalesce("artifacts", F.array().cast(rows.schema["artifacts"].dataType))
    tools = F.transform("tool_calls", lambda t: t["name"])
    none = F.array().cast("array<string>")
    ruled = F.arrays_zip("expect_artifacts", "artifact_rules")
    ruled_files = F.arrays_zip("expect_workspace_files", "workspace_rules")
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    facts = kept.select(
        "*",
        F.coalesce(F.transform(F.filter(ruled, lambda r: ~files.artifact_hit(
            r["artifact_rules"]["regex"], r["artifact_rules"]["mime"], artifacts)),
            lambda r: r["expect_artifacts"]), none).alias("missing_artifacts"),
        F.array_except("tool_rules", F.coalesce(tools, none)).alias("missing_tools"),
        F.when(F.coalesce("forbid_artifacts", F.lit(False)),
               F.transform(artifacts, lambda a: a["path"])).otherwise(none).alias("forbidden_files"),
        F.coalesce(F.transform(F.filter(ruled_files, lambda r: ~F.coalesce(
            files.workspace_hit(r["workspace_rules"], F.col("workspace_files")), F.lit(False))),
            lambda r: r["expect_workspace_files"]), none).alias("missing_workspace"),
        (~ok).alias("not_ok"))
    hard = F.col("not_ok")
    for name in ("missing_artifacts", "missing_tools", "forbidden_files", "missing_workspace"):
        hard = hard | (F.size(name) > 0)
    facts = facts.withColumn("hard", hard)
    if gradings is None:
        facts = grading_facts(facts)
    else:
        facts = facts.join(grading_facts(gradings.select(*on, "expectations", "dimensions")), list(on), "left")
    hard, soft = F.col("hard"), F.coalesce("soft", F.lit(False))

    def listed(label: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(
            F.lit(f"{label}: "), F.array_join(column, ", ")))

    assertions = F.when(F.size("failed_assertions") > 0, F.concat(
        F.lit("failed assertions: "), F.array_join(F.transform(
            "failed_assertions", lambda e: F.concat_ws(" | ", e["text"], e["evidence"])), "; ")))
    low = F.when(F.size("low_dimensions") > 0, F.concat(
        F.lit("low dimensions: "), F.array_join(F.transform(
            "low_dimensions",
            lambda d: F.concat(d["dimension"], F.lit("="), d["score"].cast("string"))), "; ")))
    excerpts = F.array_join(F.transform(artifacts, lambda a: F.concat_ws(
        "\n", a["path"], F.coalesce(non_empty(a["text_excerpt"]), F.lit("(not visible)")))), "\n")
    detail = F.concat_ws(
        "\n",
        F.when(F.col("not_ok"), F.concat(
            F.lit("run did not succeed: "), F.coalesce(non_empty(F.col("error")), F.lit("(no text)")))),
        listed("missing artifacts", "missing_artifacts"), listed("missing tools", "missing_tools"),
        listed("forbidden files", "forbidden_files"),
        listed("missing workspace files", "missing_workspace"),
        assertions, low, non_empty(excerpts))
    raw = F.coalesce(*[non_empty(F.col(c)) for c in
                       ("final_answer", "raw_output", "reasoning", "error")], F.lit(""))
    return facts.filter(hard | soft).select(
        *RUN_KEY, F.when(hard, "task_completion").otherwise("assertion").alias("metric"),
        "expected_skills",
        F.when(F.size("loaded_skills") > 0, F.col("loaded_skills"))
        .otherwise(F.col("selected_skills")).alias("selected_skills"),
        raw.alias("raw_output"), detail.alias("failure_detail"))


def cluster_violations(clusters: DataFrame, evidence: DataFrame, failures: DataFrame) -> DataFrame:
    """Why a set of suggestion clusters cannot be accepted, one row per reason.

    `clusters`: set_id, cluster_id, case_id. `evidence`: set_id, cluster_id,
    case_id, quote. `failures`: set_id, case_id, raw_output, failure_detail.
    """
    out = ["set_id", "subject", "problem"]
    failing = failures.select("set_id", "case_id").distinct()
    named = clusters.select("set_id", "cluster_id", "case_id").distinct()

    def report(df: DataFrame, problem: str) -> DataFrame:
        return df.select("set_id", F.col("case_id").alias("subject"), F.lit(problem).alias("problem")) \
            .distinct().select(*out)

    key = ["set_id", "cluster_id", "case_id"]
    quotes = evidence.join(named, key, "left_semi").withColumn("_needle", quotable(F.col("quote")))
    texts = failures.select(
        "set_id", "case_id", F.explode(F.array_compact(F.array("raw_output", "failure_detail")))
        .alias("_text")).withColumn("_hay", quotable(F.col("_text"))).drop("_text")
    found = texts.join(quotes, ["set_id", "case_id"]) \
        .filter(F.col("_hay").contains(F.col("_needle"))).select(*key, "_needle").distinct()
    cluster_count = clusters.groupBy("set_id").agg(F.count_distinct("cluster_id").alias("_clusters"))
    case_count = failing.groupBy("set_id").agg(F.count(F.lit(1)).alias("_cases"))
    unclustered = case_count.join(cluster_count, "set_id") \
        .filter("_cases > 1 AND _clusters >= _cases") \
        .select("set_id", F.lit(None).cast("string").alias("subject"),
                F.lit("not clustered").alias("problem"))
    return (
        report(named.join(failing, ["set_id", "case_id"], "left_anti"), "not a failing case")
        .unionByName(report(evidence.join(named, key, "left_anti"), "evidence outside its cluster"))
        .unionByName(report(quotes.join(found, [*key, "_needle"], "left_anti"),
                            "quote not in the case's output"))
        .unionByName(report(failing.join(named, ["set_id", "case_id"], "left_anti"), "case not covered"))
        .unionByName(report(joins.duplicate_keys(clusters, ["set_id", "case_id"]), "case in two clusters"))
        .unionByName(unclustered)
    )
