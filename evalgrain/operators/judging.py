"""Tables around an external judge: what to ask, what came back, what it adds up to.

The judge itself is called outside. Its requests are a table and its answers
are a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import text
from evalgrain.functions.cases import dimension_applicable
from evalgrain.operators import joins, ordered
from evalgrain.operators.joins import CONVERSATION, RUN_KEY


def answer_text() -> Column:
    """What a judge sees as the answer of a turn."""
    return F.coalesce(*[text.non_empty(F.col(c)) for c in ("final_answer", "raw_output", "error")],
                      F.lit(""))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """User and assistant messages of each conversation, numbered in log order.

    System-failed turns and turns with nothing to judge are part of the
    conversation; skipped turns never happened.
    """
    spoken = ordered.positions(turns.filter("status <> 'skipped'"), CONVERSATION, "line_no", "_n")
    message = F.explode(F.array(
        F.struct((2 * F.col("_n") - 1).alias("message_no"), F.lit("user").alias("role"),
                 F.col("prompt").alias("content")),
        F.struct((2 * F.col("_n")).alias("message_no"), F.lit("assistant").alias("role"),
                 answer_text().alias("content"))))
    return spoken.select(*RUN_KEY, message.alias("_m")).select(*RUN_KEY, "_m.*")


def conversation_history(turns: DataFrame) -> DataFrame:
    """Per turn, how many messages of `conversation_messages` precede it.

    A prefix length stands for the history, so the text of a long conversation
    is stored once and not again with every turn.
    """
    spoken = ordered.running_totals(
        turns, CONVERSATION, "line_no",
        {"_spoken": F.when(F.col("status") != "skipped", F.lit(1)).otherwise(F.lit(0)).cast("bigint")})
    own = F.when(F.col("status") != "skipped", F.lit(1)).otherwise(F.lit(0))
    return spoken.withColumn("history_messages", 2 * (F.col("_spoken") - own)).drop("_spoken")


def grading_class(has_dimensions: Column) -> Column:
    nothing = (F.coalesce(F.size("expect_assertions"), F.lit(0)) <= 0) & ~has_dimensions
    return (
        F.when(F.col("status") == "skipped", "skipped")
        .when(nothing, "nothing_to_judge")
        .when(F.col("error_kind").isin(*text.SYSTEM_KINDS), "system_failure")
        .otherwise("candidate")
    )


def grading_candidates(turns: DataFrame, has_dimensions: Column) -> DataFrame:
    return turns.withColumn("grading_class", grading_class(has_dimensions))


def grading_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("run_id", "grading_class").agg(F.count(F.lit(1)).alias("n"))


def applicable_dimensions(turns: DataFrame, catalog: DataFrame) -> DataFrame:
    """(run key, dimension, applicable) for the dimensions each run asked for.

    `turns` has the run key, `dimensions` (array asked for), reference and
    n_artifacts.
    """
    asked = turns.select(
        *RUN_KEY, "reference", "n_artifacts", F.posexplode("dimensions").alias("position", "dimension"))
    fits = dimension_applicable(
        F.col("requires"), F.coalesce(F.col("reference") != "", F.lit(False)),
        F.coalesce(F.col("n_artifacts") > 0, F.lit(False)))
    return asked.join(catalog, "dimension") \
        .select(*RUN_KEY, "position", "dimension", "version", fits.alias("applicable"))


def grading_requests(candidates: DataFrame) -> DataFrame:
    """The request table for output judging: one row per run turn, no text cut or repeated.

    `history_messages` points into `conversation_messages`; binary artifacts
    carry metadata only.
    """
    artifacts = F.transform("artifacts", lambda a: F.struct(
        a["path"].alias("path"), a["size_bytes"].alias("size_bytes"),
        a["mime_type"].alias("mime_type"), a["sha256"].alias("sha256"),
        a["text_excerpt"].alias("content")))
    tools = F.transform("tool_calls", lambda t: F.struct(
        t["name"].alias("name"), t["count"].alias("count"), t["failures"].alias("failures")))
    return candidates.filter("grading_class = 'candidate'").select(
        *RUN_KEY, "history_messages", "prompt", "reference",
        F.to_json("files").alias("files"), F.to_json("expect_assertions").alias("assertions"),
        F.to_json("dimensions").alias("dimensions"), answer_text().alias("output"),
        F.to_json(artifacts).alias("artifacts"), F.to_json(tools).alias("tools"))


def trajectory_requests(runs: DataFrame) -> DataFrame:
    """The request table for trajectory judging; system failures and skipped turns are left out."""
    kept = runs.filter("status <> 'skipped'").filter(
        F.col("error_kind").isNull() | ~F.col("error_kind").isin(*text.SYSTEM_KINDS))
    return kept.select(
        *RUN_KEY, "prompt", F.to_json("expect_trajectory").alias("expectation"),
        F.to_json("trajectory").alias("events"), F.to_json("tool_calls").alias("tools"),
        F.to_json("artifacts").alias("artifacts"), answer_text().alias("output"))


def validate_judgements(answers: DataFrame) -> DataFrame:
    """Add `problem`: NULL when the judge answered exactly what was asked, in order.

    Input per run turn: expectations (text, passed, evidence), dimensions
    (dimension, score, evidence), asked_assertions, asked_dimensions.
    """
    texts = F.transform("expectations", lambda e: e["text"])
    names = F.transform("dimensions", lambda d: d["dimension"])

    def blank(value: Column) -> Column:
        return F.coalesce(value == "", F.lit(True))

    no_proof = F.exists("expectations", lambda e: blank(e["evidence"]) | e["passed"].isNull()) \
        | F.exists("dimensions", lambda d: blank(d["evidence"]))
    bad_score = F.exists(
        "dimensions", lambda d: F.coalesce(~d["score"].between(0, 1), F.lit(True)))
    problem = (
        F.when(~texts.eqNullSafe(F.col("asked_assertions")), "assertions differ from request")
        .when(~names.eqNullSafe(F.col("asked_dimensions")), "dimensions differ from request")
        .when(bad_score, "score outside 0..1")
        .when(no_proof, "missing evidence")
    )
    return answers.withColumn("problem", problem)


def validate_trajectory_judgements(answers: DataFrame) -> DataFrame:
    """The trajectory variant: a NULL score is an answer (N/A)."""
    names = F.transform("dimensions", lambda d: d["dimension"])
    problem = (
        F.when(~names.eqNullSafe(F.col("asked_dimensions")), "dimensions differ from request")
        .when(F.exists("dimensions", lambda d: F.coalesce(~d["score"].between(0, 1), F.lit(False))),
              "score outside 0..1")
        .when(F.exists("dimensions", lambda d: F.coalesce(d["evidence"] == "", F.lit(True))),
              "missing evidence")
    )
    return answers.withColumn("problem", problem)


def grade_rollup(graded: DataFrame) -> DataFrame:
    """passed, failed, total, pass_rate per graded run turn; no assertions means NULL."""
    passed = F.size(F.filter("expectations", lambda e: e["passed"]))
    total = F.size("expectations")
    return graded.withColumn("passed", passed).withColumn("total", total) \
        .withColumn("failed", total - passed) \
        .withColumn("pass_rate", F.try_divide(passed.cast("double"), total.cast("double")))


def assertion_pass_rate(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """Passed over all assertions of a run, each assertion counted once."""
    return rolled.groupBy(*keys).agg(
        F.sum("passed").alias("passed"), F.sum("total").alias("total"),
        F.try_divide(F.sum("passed").cast("double"), F.sum("total").cast("double"))
        .alias("assertion_pass_rate"))


def dimension_means(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of judged scores. `scores`: keys, dimension, score; a NULL score is N/A."""
    return scores.groupBy(*keys, "dimension").agg(
        F.avg("score").alias("mean"), F.count("score").alias("n"))


def self_judge(models: DataFrame, judges: DataFrame) -> DataFrame:
    """Per run with a judge: self, independent, or unverified when no model is known.

    `models`: run_id, model (configured or observed). `judges`: run_id, judge_model.
    """
    identities = models.filter("model IS NOT NULL AND model <> ''") \
        .select("run_id", text.model_identity(F.col("model")).alias("_identity")).distinct()
    judged = judges.filter("judge_model IS NOT NULL AND judge_model <> ''") \
        .withColumn("judge_identity", text.model_identity(F.col("judge_model")))
    per_run = judged.join(identities, "run_id", "left").groupBy("run_id", "judge_identity").agg(
        F.count("_identity").alias("models"),
        F.coalesce(F.bool_or(F.col("_identity") == F.col("judge_identity")), F.lit(False)).alias("_self"))
    independence = F.when(F.col("models") == 0, "unverified").when(F.col("_self"), "self") \
        .otherwise("independent")
    return per_run.select("run_id", "judge_identity", "models", independence.alias("independence"))


def judge_selection(gradings: DataFrame, configured: DataFrame) -> DataFrame:
    """Gradings of the judge each run names. `configured`: run_id, judge_id; others give no rows."""
    return configured.filter("judge_id IS NOT NULL").join(gradings, ["run_id", "judge_id"])


def ambiguous_judges(gradings: DataFrame, configured: DataFrame) -> DataFrame:
    """Runs that hold gradings but name no judge: nothing may be picked for them."""
    unnamed = configured.filter("judge_id IS NULL").select("run_id")
    return gradings.join(unnamed, "run_id", "left_semi").groupBy("run_id") \
        .agg(F.count_distinct("judge_id").alias("judges"))


def disputed_rejections(verdicts: DataFrame) -> DataFrame:
    """No-skill cases for which an independent reader names a skill. `verdicts`: keys, should_activate."""
    return verdicts.filter(F.size("should_activate") > 0)


def rejection_review_violations(cases: DataFrame, verdicts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reasons a review cannot be used: cases it misses or adds, skills that do not exist."""
    gaps = joins.coverage(cases, verdicts, ["case_id"]).withColumnRenamed("case_id", "subject")
    unknown = verdicts.select(F.explode("should_activate").alias("skill_id")).distinct() \
        .join(catalog.select("skill_id"), "skill_id", "left_anti") \
        .select(F.col("skill_id").alias("subject"), F.lit("unknown skill").alias("problem"))
    return gaps.unionByName(unknown)
