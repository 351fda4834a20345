"""Queries on judge tables and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.operators import calibration, joins, judging
from evalgrain.plans import bindings as b
from evalgrain.plans.bindings import Lake
from evalgrain.plans.catalog import query, sql
from evalgrain.schemas import dimension_catalog

TALK_SQL = """
spoken AS (SELECT *, row_number() OVER (PARTITION BY run_id, case_id, repeat_index ORDER BY line_no) AS n FROM turns WHERE status <> 'skipped')"""


def talk(lake: Lake) -> DataFrame:
    """Turns as a judge meets them: the text is the prompt, the answer is made from it."""
    rows = b.turns(lake)
    n = F.length("text")
    return rows.withColumns({
        "prompt": F.col("text"), "final_answer": F.when(n % 3 == 0, F.reverse("text")),
        "raw_output": F.when(n % 3 == 1, F.concat(F.lit("raw "), "text")), "error": F.lit("none"),
        "expect_assertions": F.when(n % 5 == 0, b.strings()).otherwise(b.strings("claim")),
    })


ANSWER_CHARS = "CASE length(text) % 3 WHEN 2 THEN 4 WHEN 1 THEN length(text) + 4 ELSE length(text) END"


@query("H1_conversation_messages", sql(b.TURNS_SQL, TALK_SQL, f"""
SELECT run_id, case_id, turn_index, 2 * n - 1 AS message_no, 'user' AS role, length(text) AS chars FROM spoken
UNION ALL SELECT run_id, case_id, turn_index, 2 * n, 'assistant', {ANSWER_CHARS} FROM spoken"""))
def conversation_messages(lake: Lake) -> DataFrame:
    return judging.conversation_messages(talk(lake)).select(
        "run_id", "case_id", "turn_index", "message_no", "role", F.length("content").cast("bigint").alias("chars"))


@query("H1_conversation_history", sql(b.TURNS_SQL, """
SELECT run_id, case_id, turn_index, (2 * coalesce(sum(CASE WHEN status <> 'skipped' THEN 1 ELSE 0 END)
   OVER (PARTITION BY run_id, case_id, repeat_index ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS history_messages
FROM turns"""))
def conversation_history(lake: Lake) -> DataFrame:
    return judging.conversation_history(talk(lake)).select("run_id", "case_id", "turn_index", "history_messages")


CLASS_SQL = """
cls AS (SELECT *, CASE WHEN status = 'skipped' THEN 'skipped' WHEN length(text) % 5 = 0 THEN 'nothing_to_judge'
   WHEN error_kind IN ('runtime', 'network', 'harness') THEN 'system_failure' ELSE 'candidate' END AS grading_class FROM turns)"""


@query("H2_grading_candidates", sql(b.TURNS_SQL, CLASS_SQL, """
SELECT run_id, grading_class, count(*) AS n FROM cls GROUP BY 1, 2"""))
def grading_candidates(lake: Lake) -> DataFrame:
    return judging.grading_counts(judging.grading_candidates(talk(lake), F.lit(False)))


@query("H3_grading_requests", sql(b.TURNS_SQL, CLASS_SQL, """
SELECT run_id, case_id, turn_index, text AS prompt, '["claim"]' AS assertions, '["in.txt"]' AS files,
       '[{"path":"a","size_bytes":1,"mime_type":"text/plain","sha256":"' || sha256(text) || '","content":"x"}]' AS artifacts,
       ANSWER_CHARS AS output_chars
FROM cls WHERE grading_class = 'candidate'""".replace("ANSWER_CHARS", ANSWER_CHARS)))
def grading_requests(lake: Lake) -> DataFrame:
    classified = judging.grading_candidates(judging.conversation_history(talk(lake)), F.lit(False))
    ready = classified.withColumns({
        "reference": F.lit(None).cast("string"), "files": b.strings("in.txt"),
        "dimensions": b.strings(),
        "artifacts": F.array(F.struct(
            F.lit("a").alias("path"), F.lit(1).alias("size_bytes"), F.lit("text/plain").alias("mime_type"),
            F.sha2("text", 256).alias("sha256"), F.lit("x").alias("text_excerpt"))),
        "tool_calls": F.array(F.struct(
            F.lit("t").alias("name"), F.lit(1).alias("count"), F.lit(0).alias("failures")))})
    return judging.grading_requests(ready).select(
        "run_id", "case_id", "turn_index", "prompt", "assertions", "files", "artifacts",
        F.length("output").cast("bigint").alias("output_chars"))


def answers(lake: Lake) -> DataFrame:
    """One judge answer per judged document; some name another assertion, leave the range, or prove nothing."""
    n = F.col("n_chars")
    expectation = F.array(F.struct(
        F.when(n % 7 == 0, F.lit("other")).otherwise(F.col("assertion")).alias("text"),
        F.col("judge_passed").alias("passed"),
        F.when(n % 11 == 0, F.lit("")).otherwise("seen").alias("evidence")))
    score = F.when(n % 13 == 0, F.lit(1.5)).otherwise(F.col("judge_score"))
    dimension = F.array(F.struct(
        F.col("dimension").alias("dimension"), score.alias("score"), F.lit("seen").alias("evidence")))
    return b.judged(lake).withColumns({
        "run_id": F.col("judge_id"), "expectations": expectation, "dimensions": dimension,
        "asked_assertions": F.array("assertion"), "asked_dimensions": F.array("dimension")})


PROBLEM_SQL = """
ans AS (SELECT *, CASE WHEN n_chars % 7 = 0 THEN 'assertions differ from request' WHEN n_chars % 13 = 0 THEN 'score outside 0..1'
   WHEN n_chars % 11 = 0 THEN 'missing evidence' END AS problem FROM judged)"""


@query("H4_validate_judgements", sql(b.JUDGED_SQL, PROBLEM_SQL, """
SELECT judge_id, problem, count(*) AS n FROM ans GROUP BY 1, 2"""))
def validate_judgements(lake: Lake) -> DataFrame:
    return judging.validate_judgements(answers(lake)).groupBy("judge_id", "problem") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("H4_validate_trajectory_judgements", sql(b.JUDGED_SQL, """
SELECT judge_id, CASE WHEN n_chars % 13 = 0 THEN 'score outside 0..1' END AS problem, count(*) AS n FROM judged GROUP BY 1, 2"""))
def validate_trajectory_judgements(lake: Lake) -> DataFrame:
    return judging.validate_trajectory_judgements(answers(lake)).groupBy("judge_id", "problem") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("H5_grade_rollup", sql(b.JUDGED_SQL, PROBLEM_SQL, """
SELECT judge_id AS run_id, sum(judge_passed::INT)::BIGINT AS passed, count(*) AS total, avg(judge_passed::INT) AS assertion_pass_rate
FROM ans WHERE problem IS NULL GROUP BY 1"""))
def grade_rollup(lake: Lake) -> DataFrame:
    valid = judging.validate_judgements(answers(lake)).filter("problem IS NULL")
    return judging.assertion_pass_rate(judging.grade_rollup(valid), ["run_id"])


@query("H6_dimension_means", sql(b.JUDGED_SQL, PROBLEM_SQL, """
SELECT judge_id AS run_id, dimension, round(avg(judge_score), 6) AS mean, count(*) AS n FROM ans WHERE problem IS NULL GROUP BY 1, 2"""))
def dimension_means(lake: Lake) -> DataFrame:
    valid = judging.validate_judgements(answers(lake)).filter("problem IS NULL")
    scores = valid.select("run_id", F.explode("dimensions").alias("_d")).select("run_id", "_d.dimension", "_d.score")
    return judging.dimension_means(scores, ["run_id"]).withColumn("mean", F.round("mean", 6))


@query("H7_self_judge", """
SELECT o_custkey::VARCHAR AS run_id, judge AS judge_identity, count(DISTINCT m) AS models,
       CASE WHEN count(m) = 0 THEN 'unverified' WHEN bool_or(m = judge) THEN 'self' ELSE 'independent' END AS independence FROM (
  SELECT o_custkey, 'seg-' || (o_custkey % 4) AS judge, CASE WHEN o_orderstatus <> 'P' THEN 'seg-' || (o_orderkey % 5) END AS m FROM orders) x
GROUP BY o_custkey, judge""")
def self_judge(lake: Lake) -> DataFrame:
    models = lake.orders.select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Hub/SEG-"), F.col("o_orderkey") % 5, F.lit("/")))
        .alias("model"))
    judges = lake.orders.select(
        F.col("o_custkey").cast("string").alias("run_id"),
        F.concat(F.lit("open/Seg-"), F.col("o_custkey") % 4).alias("judge_model")).distinct()
    return judging.self_judge(models, judges)


@query("H8_judge_selection", sql(b.JUDGED_SQL, """
SELECT source AS run_id, judge_id, count(*) AS n FROM judged WHERE judge_id = CASE source WHEN 'src1' THEN 'judge1' ELSE 'judge0' END
AND source <> 'src2' GROUP BY 1, 2"""))
def judge_selection(lake: Lake) -> DataFrame:
    rows = b.judged(lake).withColumn("run_id", F.col("source"))
    named = rows.select("run_id").distinct().withColumn(
        "judge_id", F.when(F.col("run_id") == "src1", "judge1").when(F.col("run_id") != "src2", "judge0"))
    return judging.judge_selection(rows, named).groupBy("run_id", "judge_id").agg(F.count(F.lit(1)).alias("n"))


@query("H8_ambiguous_judges", sql(b.JUDGED_SQL, """
SELECT source AS run_id, count(DISTINCT judge_id) AS judges FROM judged WHERE source IN ('src2', 'src3') GROUP BY 1"""))
def ambiguous_judges(lake: Lake) -> DataFrame:
    rows = b.judged(lake).withColumn("run_id", F.col("source"))
    named = rows.select("run_id").distinct().withColumn(
        "judge_id", F.when(~F.col("run_id").isin("src2", "src3"), "judge0"))
    return judging.ambiguous_judges(rows, named)


@query("H9_disputed_rejections", sql(b.CASESET_SQL, """
SELECT line_no, id, source AS skill_id FROM caseset WHERE kind = 'rej' AND n_chars % 2 = 0"""))
def disputed_rejections(lake: Lake) -> DataFrame:
    verdicts = b.caseset(lake).filter("kind = 'rej'").withColumn(
        "should_activate", F.when(F.col("n_chars") % 2 == 0, b.strings(F.col("source"))).otherwise(b.strings()))
    return judging.disputed_rejections(verdicts).select(
        "line_no", "id", F.explode("should_activate").alias("skill_id"))


@query("H9_rejection_review_violations", sql(b.CASESET_SQL, """
SELECT 'd' || doc_id AS subject, 'missing' AS problem FROM caseset WHERE kind = 'rej' AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'd' || doc_id, 'unexpected' FROM labels WHERE doc_id IN (SELECT doc_id FROM caseset WHERE kind <> 'rej')
UNION ALL SELECT DISTINCT source, 'unknown skill' FROM labels JOIN documents USING (doc_id) WHERE source NOT IN ('src1', 'src2', 'src3')"""))
def rejection_review_violations(lake: Lake) -> DataFrame:
    cases = b.caseset(lake).filter("kind = 'rej'").select(F.concat(F.lit("d"), "doc_id").alias("case_id"))
    verdicts = lake.labels.join(lake.documents.select("doc_id", "source"), "doc_id").select(
        F.concat(F.lit("d"), "doc_id").alias("case_id"), F.array("source").alias("should_activate"))
    catalog = lake.documents.filter(F.col("source").isin("src1", "src2", "src3")) \
        .select(F.col("source").alias("skill_id")).distinct()
    return judging.rejection_review_violations(cases, verdicts, catalog)


@query("B28_applicable", sql(b.JUDGED_SQL, """
SELECT doc_id, dimension, CASE WHEN dimension = 'correctness' THEN n_chars % 2 = 0 ELSE true END AS applicable
FROM (SELECT doc_id, n_chars, unnest(['correctness', 'relevancy']) AS dimension FROM judged) x"""))
def applicable(lake: Lake) -> DataFrame:
    turns = b.judged(lake).withColumns({
        "run_id": F.col("doc_id").cast("string"), "dimensions": b.strings("correctness", "relevancy"),
        "reference": F.when(F.col("n_chars") % 2 == 0, "gold"), "n_artifacts": F.lit(0)})
    rows = judging.applicable_dimensions(turns, dimension_catalog(lake.spark))
    return rows.select(F.col("run_id").cast("bigint").alias("doc_id"), "dimension", "applicable")


# --- calibration --------------------------------------------------------------


def gold(lake: Lake) -> DataFrame:
    return b.judged(lake).select("calibration_id", "case_id", "assertion",
                                 F.col("human_passed").alias("passed"), F.lit("why").alias("rationale"))


def machine(lake: Lake) -> DataFrame:
    return b.judged(lake).select("calibration_id", "judge_id", "case_id", "assertion",
                                 F.col("judge_passed").alias("passed"), F.lit("seen").alias("evidence"))


@query("I1_assertion_agreement", sql(b.JUDGED_SQL, """
SELECT calibration_id, judge_id, count(*) AS n_annotations, avg((human_passed = judge_passed)::INT) AS agreement FROM judged GROUP BY 1, 2"""))
def assertion_agreement(lake: Lake) -> DataFrame:
    return calibration.assertion_agreement(calibration.assertion_pairs(gold(lake), machine(lake)))


@query("I2_invalid_output_rate", sql(b.JUDGED_SQL, """
SELECT judge_id, count(*) FILTER (WHERE failed) AS invalid_outputs, count(*) AS attempted_calls, avg(failed::INT) AS invalid_output_rate
FROM judged GROUP BY 1"""))
def invalid_output_rate(lake: Lake) -> DataFrame:
    return calibration.invalid_output_rate(b.judged(lake), ["judge_id"])


@query("I3_assertion_disagreements", sql(b.JUDGED_SQL, """
SELECT judge_id, case_id, assertion, human_passed, judge_passed FROM judged WHERE human_passed <> judge_passed"""))
def assertion_disagreements(lake: Lake) -> DataFrame:
    pairs = calibration.assertion_pairs(gold(lake), machine(lake))
    return calibration.assertion_disagreements(pairs).select(
        "judge_id", "case_id", "assertion", "human_passed", "judge_passed")


def score_gold(lake: Lake) -> DataFrame:
    return b.judged(lake).select(*calibration.JUDGE, *calibration.SCORE, F.col("human_score").alias("score"))


def score_judged(lake: Lake) -> DataFrame:
    return b.judged(lake).filter("NOT failed").select(
        *calibration.JUDGE, *calibration.SCORE, F.col("judge_score").alias("score"))


AGREEMENT_SQL = """
agr AS (SELECT calibration_id, judge_id, dimension, count(*) AS n_annotations, count(*) FILTER (WHERE NOT failed) AS n_valid,
   coalesce(avg(CASE WHEN NOT failed THEN (abs(judge_score - human_score) <= 0.25)::INT END), 0) AS agreement,
   round(avg(CASE WHEN NOT failed THEN abs(judge_score - human_score) END), 6) AS mean_absolute_error FROM judged GROUP BY 1, 2, 3)"""


@query("I4_I5_dimension_agreement", sql(b.JUDGED_SQL, AGREEMENT_SQL, "SELECT * FROM agr"))
def dimension_agreement(lake: Lake) -> DataFrame:
    return calibration.dimension_agreement(score_gold(lake), score_judged(lake)) \
        .withColumn("mean_absolute_error", F.round("mean_absolute_error", 6))


INVALID_SQL = """
inv AS (SELECT calibration_id, judge_id, dimension, count(*) FILTER (WHERE failed) AS invalid_outputs, count(*) AS attempted_calls,
   avg(failed::INT) AS invalid_output_rate FROM judged GROUP BY 1, 2, 3)"""


@query("I6_dimension_invalid_rate", sql(b.JUDGED_SQL, INVALID_SQL, "SELECT * FROM inv"))
def dimension_invalid_rate(lake: Lake) -> DataFrame:
    return calibration.dimension_invalid_rate(score_gold(lake), b.judged(lake).filter("failed"))


@query("I7_qualification", sql(b.JUDGED_SQL, AGREEMENT_SQL, INVALID_SQL, """
SELECT agr.judge_id, agr.dimension, n_annotations >= 10 AND n_valid > 0 AND agreement >= 0.8 AND invalid_output_rate <= 0.02 AS qualified
FROM agr JOIN inv ON agr.judge_id = inv.judge_id AND agr.dimension = inv.dimension"""))
def qualification(lake: Lake) -> DataFrame:
    agreement = calibration.dimension_agreement(score_gold(lake), score_judged(lake))
    invalid = calibration.dimension_invalid_rate(score_gold(lake), b.judged(lake).filter("failed"))
    return agreement.join(invalid, [*calibration.JUDGE, "dimension"]).select(
        "judge_id", "dimension", calibration.dimension_qualified(
            F.col("agreement"), F.col("invalid_output_rate"), F.col("n_annotations"), F.col("n_valid"))
        .alias("qualified"))


@query("I8_rubric_version_check", sql(b.JUDGED_SQL, """
SELECT DISTINCT judge_id, dimension, 'v1' AS version, CASE WHEN dimension = 'relevancy' THEN NULL ELSE 'v2' END AS judge_version
FROM judged WHERE dimension = 'relevancy' OR judge_id = 'judge1'"""))
def rubric_version_check(lake: Lake) -> DataFrame:
    seen = b.judged(lake).select(*calibration.JUDGE, "dimension").distinct()
    gold_versions = seen.withColumn("version", F.lit("v1"))
    judge_versions = seen.filter("dimension <> 'relevancy'").withColumn(
        "version", F.when(F.col("judge_id") == "judge1", "v2").otherwise("v1"))
    return calibration.rubric_version_mismatch(gold_versions, judge_versions) \
        .select("judge_id", "dimension", "version", "judge_version")


@query("I9_policy_floor", """
SELECT p_partkey, CASE WHEN p_size < 20 THEN 'thresholds below policy' WHEN p_type = 'ECONOMY' AND p_size > 45 THEN 'dimension policy too loose'
   WHEN p_type = 'ECONOMY' AND p_retailprice < 950 THEN 'too few annotations' END AS problem
FROM part WHERE p_size < 20 OR (p_type = 'ECONOMY' AND (p_size > 45 OR p_retailprice < 950))""")
def policy_floor(lake: Lake) -> DataFrame:
    size = F.col("p_size")
    reports = lake.part.select(
        "p_partkey",
        F.when(F.col("p_type") == "ECONOMY", "standard_dimension").otherwise("absolute_assertions").alias("scope"),
        F.lit(True).alias("qualified"), F.when(size < 20, 0.5).otherwise(0.85).alias("agreement_min"),
        F.lit(0.02).alias("invalid_max"), F.when(size > 45, 0.5).otherwise(0.25).alias("tolerance"),
        F.lit(10).alias("annotations_min"),
        F.when(F.col("p_retailprice") < 950, 3).otherwise(12).alias("n_annotations"))
    return calibration.policy_violations(reports).select("p_partkey", "problem")


def gauge(model: Column) -> Column:
    """A judge struct whose id is no part of its fingerprint."""
    return F.struct(
        model.alias("model"), F.lit("BASE").alias("api_base_env"), F.lit("h").alias("system_prompt_hash"),
        F.create_map(F.lit("temperature"), F.lit("0")).alias("params"),
        F.create_map(F.lit("relevancy"), F.lit("v1")).alias("dimensions"))


def records(lake: Lake) -> DataFrame:
    return lake.part.select(
        F.lit("standard_dimension").alias("scope"), F.col("p_type").alias("dimension"),
        calibration.fingerprint(gauge(F.col("p_brand"))).alias("fingerprint"),
        (F.col("p_size") / 50).alias("agreement"), (F.col("p_partkey") % 3 / 100).alias("invalid_output_rate"),
        F.col("p_partkey").alias("position"), F.col("p_brand").alias("model"))


BEST_SQL = """
best AS (SELECT * FROM (SELECT p_type AS dimension, p_brand AS model, p_size / 50 AS agreement, p_partkey % 3 / 100 AS invalid_output_rate, p_partkey AS position,
   row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size DESC, p_partkey % 3, p_partkey) AS r FROM part) x WHERE r = 1)"""


@query("I10_registry_best", sql(BEST_SQL, "SELECT dimension, model, agreement, invalid_output_rate, position FROM best"))
def registry_best(lake: Lake) -> DataFrame:
    return calibration.registry_best(records(lake)).select(
        "dimension", "model", "agreement", "invalid_output_rate", "position")


@query("I11_registry_evidence_check", """
SELECT 'e' || p_partkey AS entry_id, problem FROM (
  SELECT p_partkey, unnest([CASE WHEN p_size = 1 THEN 'evidence not unique' WHEN p_size % 10 = 3 THEN 'values differ from evidence' END,
         CASE WHEN p_size % 10 = 5 THEN 'report hash differs' END,
         CASE WHEN p_size = 7 THEN 'entry id repeated' END]) AS problem FROM part) x WHERE problem IS NOT NULL""")
def registry_evidence_check(lake: Lake) -> DataFrame:
    """Entries from parts; evidence is missing, changed or re-hashed for some sizes, ids repeat for one."""
    size, key = F.col("p_size"), F.col("p_partkey")
    base = lake.part.select(
        F.concat(F.lit("e"), key).alias("entry_id"), F.lit("cal").alias("calibration_id"),
        F.lit("standard_dimension").alias("scope"), F.lit("relevancy").alias("dimension"),
        F.concat(F.lit("fp"), key).alias("fingerprint"), F.lit("j").alias("evidence_judge_id"),
        (size / 50).alias("agreement"), F.lit(0.0).alias("invalid_output_rate"),
        F.lit(0.25).alias("agreement_tolerance"), F.lit(0.1).alias("mean_absolute_error"),
        F.lit(True).alias("qualified"), F.concat(F.lit("report-"), key).alias("evidence_report"),
        F.lit("h1").alias("report_hash"), size.alias("size"))
    second = base.filter("size = 7").withColumn("fingerprint", F.concat("fingerprint", F.lit("b"))) \
        .withColumn("evidence_report", F.concat("evidence_report", F.lit("b")))
    entries = base.unionByName(second)
    evidence = entries.filter("size <> 1").select(
        "evidence_report", F.lit("j").alias("judge_id"), "fingerprint", "dimension",
        F.when(F.col("size") % 10 == 3, F.col("agreement") + 0.01).otherwise(F.col("agreement")).alias("agreement"),
        "invalid_output_rate", "agreement_tolerance", "mean_absolute_error", "qualified")
    reports = entries.select(
        "evidence_report", F.when(F.col("size") % 10 == 5, "h2").otherwise("h1").alias("actual_hash"),
        F.lit("cal").alias("report_calibration_id"))
    return calibration.registry_violations(entries.drop("size"), evidence, reports) \
        .select("entry_id", "problem").distinct()


def gate_rows(lake: Lake) -> DataFrame:
    metrics = ["assertion_pass_rate", "relevancy", "tool_selection", "order_correctness", "top1"]
    return lake.supplier.select(
        F.col("s_name").alias("run_id"), F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))


def proven(lake: Lake) -> DataFrame:
    return lake.supplier.filter("s_acctbal > 0").select(
        F.col("s_name").alias("run_id"), F.lit("tool_selection").alias("metric"))


SCOPE_SQL = """
g AS (SELECT s_name AS run_id, s_nationkey, s_acctbal, unnest(['assertion_pass_rate', 'relevancy', 'tool_selection', 'order_correctness', 'top1']) AS metric FROM supplier),
sc AS (SELECT *, CASE metric WHEN 'assertion_pass_rate' THEN 'absolute_assertions' WHEN 'relevancy' THEN 'standard_dimension'
   WHEN 'tool_selection' THEN CASE WHEN s_acctbal > 0 THEN NULL ELSE 'trajectory_dimension' END
   WHEN 'order_correctness' THEN 'trajectory_dimension' END AS scope FROM g)"""


@query("I12_gate_calibration_scope", sql(SCOPE_SQL, """
SELECT run_id, metric, scope, CASE WHEN scope LIKE '%dimension' THEN metric END AS dimension FROM sc"""))
def gate_calibration_scope(lake: Lake) -> DataFrame:
    return calibration.gate_calibration_scope(gate_rows(lake), proven(lake))


def matched(lake: Lake) -> DataFrame:
    """Runs use the judge of their nation; the registry knows nations' judges for two scopes."""
    nation = F.concat(F.lit("m"), F.col("s_nationkey"))
    judges = lake.supplier.select(
        F.col("s_name").alias("run_id"), calibration.fingerprint(gauge(nation)).alias("fingerprint"),
    ).withColumn("scope_kind", F.explode(F.array(F.lit("output"), F.lit("trajectory"))))
    known = calibration.fingerprint(gauge(F.concat(F.lit("m"), F.col("n_nationkey"))))
    registry = lake.nation.filter("n_name NOT IN ('NATION_20', 'NATION_21', 'NATION_22', 'NATION_23', 'NATION_24')") \
        .select(known.alias("fingerprint"), F.col("n_name").alias("entry_id"),
                (F.col("n_regionkey") != 0).alias("qualified")) \
        .withColumn("scope", F.explode(F.array(F.lit("absolute_assertions"), F.lit("standard_dimension")))) \
        .withColumn("dimension", F.when(F.col("scope") == "standard_dimension", "relevancy"))
    scoped = calibration.gate_calibration_scope(gate_rows(lake), proven(lake))
    return calibration.registry_match(scoped, judges, registry)


@query("C13_registry_match", sql(SCOPE_SQL, """
SELECT run_id, metric, CASE WHEN scope IN ('absolute_assertions', 'standard_dimension') AND s_nationkey < 20 THEN 'NATION_' || s_nationkey END AS entry_id
FROM sc WHERE scope IS NOT NULL"""))
def registry_match(lake: Lake) -> DataFrame:
    return matched(lake).select("run_id", "metric", "entry_id")


@query("I13_gate_calibration", sql(SCOPE_SQL, """
SELECT run_id, metric, coalesce(scope <> 'trajectory_dimension' AND s_nationkey < 20 AND s_nationkey % 5 <> 0, false) AS qualified,
   CASE WHEN scope = 'trajectory_dimension' OR s_nationkey >= 20 THEN 'setup is not in the registry'
        WHEN s_nationkey % 5 = 0 THEN 'registered, below its thresholds' ELSE 'qualified' END AS reason
FROM sc WHERE scope IS NOT NULL"""))
def gate_calibration(lake: Lake) -> DataFrame:
    return calibration.gate_calibration(matched(lake), F.lit(True)).select("run_id", "metric", "qualified", "reason")


@query("C6_coverage", """
SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  AND doc_id NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def coverage(lake: Lake) -> DataFrame:
    excused = lake.pages.select(F.col("page_id").alias("doc_id"))
    return joins.coverage(lake.documents, lake.labels, ["doc_id"], excused)


@query("H3_trajectory_requests", sql(b.RUNS_SQL, """
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE tax <> 4) AS with_tools FROM runs
WHERE coalesce(error_kind, '') NOT IN ('runtime', 'network', 'harness') GROUP BY run_id"""))
def trajectory_requests(lake: Lake) -> DataFrame:
    rows = b.runs(lake).withColumns({
        "prompt": F.col("case_id"), "expect_trajectory": F.struct(F.lit("g").alias("goal")),
        "trajectory": F.array(F.struct(F.lit(1).alias("step_index")))})
    return judging.trajectory_requests(rows).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("tools").alias("with_tools"))


