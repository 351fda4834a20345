"""Run logs, run snapshots and gradings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalgrain import schemas
from evalgrain.functions.text import non_empty
from evalgrain.operators.joins import RUN_KEY
from evalgrain.sources.lines import read_lines, run_id_of


def normalize_runs(runs: DataFrame) -> DataFrame:
    """Defaults of the run record. Row-local, so it serves batch and streaming input alike."""
    status = F.coalesce("status", F.lit("success"))
    kind = F.coalesce("error_kind", F.when(non_empty(F.col("error")).isNotNull(), F.lit("harness")))
    return runs.withColumns({
        "status": status,
        "turn_index": F.coalesce("turn_index", F.lit(1)),
        "repeat_index": F.coalesce("repeat_index", F.lit(0)),
        "error_kind": kind,
        "ok": F.when(F.col("status").isNotNull(), F.col("status") == "success")
        .otherwise(F.coalesce("ok", F.lit(True))),
    })


def parse_runs(lines: DataFrame, depth: int = 2) -> DataFrame:
    """Run records from (file_path, line_no, value). A line that is no record fails the job."""
    parsed = lines.filter(F.trim("value") != "").select(
        run_id_of(F.col("file_path"), depth).alias("run_id"), "line_no",
        F.from_json("value", schemas.RUNS, {"mode": "FAILFAST"}).alias("_r"))
    return normalize_runs(parsed.select("run_id", "line_no", "_r.*"))


def read_runs(spark: SparkSession, path: str | list[str], depth: int = 2) -> DataFrame:
    """Run records with run_id (the last folders of the path) and line_no."""
    return parse_runs(read_lines(spark, path), depth)


def run_record_problems(runs: DataFrame) -> DataFrame:
    """Records outside their domains, one row per problem; nothing is dropped."""
    checks = [
        (~F.col("status").isin(*schemas.RUN_STATUSES), "unknown status"),
        (~F.coalesce(F.col("error_kind").isin(*schemas.ERROR_KINDS), F.lit(True)), "unknown error kind"),
        (F.col("turn_index") < 1, "turn index below 1"),
        (F.col("case_id").isNull(), "no case id"),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks]))
    return runs.select("run_id", "line_no", "case_id", F.explode(problems).alias("problem"))


def _yaml_to_json(batches):
    for batch in batches:
        import yaml  # needed only where a snapshot is YAML

        yield pd.DataFrame({
            "file_path": batch["file_path"],
            "value": [json.dumps(yaml.safe_load(text), default=str) for text in batch["value"]]})


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_path, value): whole small files, such as snapshots and reports."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), "value")


def parse_run_dim(documents: DataFrame, depth: int = 2) -> DataFrame:
    """One row per run from its snapshot document, JSON or YAML."""
    is_json = F.col("value").rlike(r"^\s*\{")
    converted = documents.filter(~is_json).mapInPandas(_yaml_to_json, "file_path string, value string")
    return documents.filter(is_json).select("file_path", "value").unionByName(converted).select(
        run_id_of(F.col("file_path"), depth).alias("run_id"),
        F.from_json("value", schemas.RUN_DIM).alias("_d")).select("run_id", "_d.*")


def read_run_dim(spark: SparkSession, path: str | list[str], depth: int = 2) -> DataFrame:
    return parse_run_dim(read_documents(spark, path), depth)


def parse_gradings(documents: DataFrame, depth: int = 2) -> DataFrame:
    """One row per grading report; `graded_runs` and `judge_failures` open it."""
    return documents.select(
        run_id_of(F.col("file_path"), depth).alias("run_id"),
        F.from_json("value", schemas.GRADINGS, {"mode": "FAILFAST"}).alias("_g"),
    ).select("run_id", F.col("_g.judge.id").alias("judge_id"), "_g.*")


def read_gradings(spark: SparkSession, path: str | list[str], depth: int = 2) -> DataFrame:
    return parse_gradings(read_documents(spark, path), depth)


def _key_of(item: str) -> list[Column]:
    return [F.col(f"{item}.case_id").alias("case_id"),
            F.coalesce(f"{item}.repeat_index", F.lit(0)).alias("repeat_index"),
            F.coalesce(f"{item}.turn_index", F.lit(1)).alias("turn_index")]


def graded_runs(reports: DataFrame) -> DataFrame:
    return reports.select("run_id", "judge_id", F.explode("graded").alias("_i")).select(
        "run_id", "judge_id", *_key_of("_i"), "_i.expectations", "_i.dimensions",
        "_i.skipped_dimensions", "_i.passed", "_i.failed", "_i.total", "_i.pass_rate")


def graded_assertions(graded: DataFrame) -> DataFrame:
    return graded.select(
        "judge_id", *RUN_KEY, F.posexplode("expectations").alias("position", "_e")
    ).select("judge_id", *RUN_KEY, "position", F.col("_e.text").alias("assertion"),
             "_e.passed", "_e.evidence")


def graded_dimensions(graded: DataFrame) -> DataFrame:
    """A trajectory grading may hold NULL scores; they stay NULL."""
    return graded.select(
        "judge_id", *RUN_KEY, F.posexplode("dimensions").alias("position", "_d")
    ).select("judge_id", *RUN_KEY, "position", "_d.dimension", "_d.score", "_d.evidence")


def judge_failures(reports: DataFrame) -> DataFrame:
    return reports.select("run_id", "judge_id", F.explode("judge_failures").alias("_i")).select(
        "run_id", "judge_id", *_key_of("_i"), "_i.error")


def boolean_gold(documents: DataFrame) -> DataFrame:
    return _gold(documents, schemas.BOOLEAN_GOLD).select(
        "calibration_id", "source_run", F.explode("annotations").alias("_a")
    ).select("calibration_id", "source_run", "_a.*")


def score_gold(documents: DataFrame) -> DataFrame:
    return _gold(documents, schemas.SCORE_GOLD).select(
        "calibration_id", "source_run", "dimension_versions", F.explode("annotations").alias("_a")
    ).select(
        "calibration_id", "source_run", *_key_of("_a"), "_a.dimension", "_a.score", "_a.rationale",
        F.try_element_at("dimension_versions", F.col("_a.dimension")).alias("rubric_version"))


def declared_dimensions(documents: DataFrame) -> DataFrame:
    return _gold(documents, schemas.SCORE_GOLD).select(
        "calibration_id", F.explode("dimension_versions").alias("dimension", "version"))


def _gold(documents: DataFrame, schema: str) -> DataFrame:
    return documents.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_g")).select("_g.*")


def read_human_gold(spark: SparkSession, path: str | list[str], scored: bool) -> DataFrame:
    documents = read_documents(spark, path)
    return score_gold(documents) if scored else boolean_gold(documents)


def gold_problems(gold: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated keys, unknown dimensions, and declared or annotated dimensions without the other.

    `gold`: calibration_id, keys with dimension. `declared`: calibration_id, dimension.
    """
    where = ["calibration_id", "dimension"]
    twice = gold.groupBy("calibration_id", *keys).count().filter("count > 1").select(*where).distinct()
    annotated = gold.select(*where).distinct()

    def told(df: DataFrame, problem: str) -> DataFrame:
        return df.select(*where, F.lit(problem).alias("problem"))

    return told(twice, "repeated key") \
        .unionByName(told(declared.filter(~F.col("dimension").isin(*schemas.RUBRICS)), "unknown dimension")) \
        .unionByName(told(declared.join(annotated, where, "left_anti"), "declared, not annotated")) \
        .unionByName(told(annotated.join(declared, where, "left_anti"), "annotated, not declared"))


def newest(files: DataFrame, depth: int = 2) -> DataFrame:
    """The run whose log file changed last. Input: path, modificationTime."""
    last = F.max(F.struct("modificationTime", "path")).alias("_n")
    return files.agg(last).select(
        run_id_of(F.col("_n.path"), depth).alias("run_id"), F.col("_n.modificationTime").alias("modified_at"))


def latest_run(spark: SparkSession, path: str | list[str], depth: int = 2) -> DataFrame:
    """Reads only names and times of the files, not their content."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return newest(files, depth)


def trajectory_projection(runs: DataFrame) -> DataFrame:
    """The stable event view of a log, ready to be written as JSON lines."""
    return runs.select(
        "run_id", "case_id", "repeat_index", "turn_index", "request_id", "session_id", "status",
        "error_kind", F.coalesce("trajectory", F.filter("trajectory", lambda e: F.lit(False)))
        .alias("events"))


def write_scores(scores: DataFrame, path: str) -> None:
    """Write a new score table, one file per run; an existing table is never replaced."""
    scores.repartition("run_id").write.mode("errorifexists").partitionBy("run_id").parquet(path)
