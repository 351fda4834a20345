"""Queries on readers and writers. Lines and documents are made by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalgrain.operators import trajectory
from evalgrain.plans import bindings as b
from evalgrain.plans.bindings import Lake
from evalgrain.plans.catalog import query, sql
from evalgrain.schemas import EVENT
from evalgrain.session import new_folder
from evalgrain.sources import cases as case_source, runs as run_source, sessions, skills as skill_source


def run_lines(lake: Lake) -> DataFrame:
    """The runs as log lines: successful ones without status, failed ones with an error only."""
    rows = b.runs(lake)
    record = F.struct(
        "case_id", "repeat_index", F.when(F.col("status") != "success", F.col("status")).alias("status"),
        F.col("selected").alias("selected_skills"), F.col("error"), "duration_ms", "usage", "tool_calls",
        "artifacts", "workspace_files", "model")
    path = F.concat(F.lit("s3://logs/routing/"), F.col("run_id"), F.lit("/runs.jsonl"))
    lines = rows.select(path.alias("file_path"), "line_no", F.to_json(record).alias("value"))
    blank = lake.orders.select(
        F.lit("s3://logs/routing/run-F/runs.jsonl").alias("file_path"), F.col("o_orderkey").alias("line_no"),
        F.lit("  ").alias("value"))
    return lines.unionByName(blank)


@query("A1_read_runs", sql(b.RUNS_SQL, """
SELECT 'routing/' || run_id AS run_id, status, ok, CASE WHEN error IS NOT NULL THEN 'harness' END AS error_kind, turn_index, count(*) AS n,
       sum(duration_ms)::BIGINT AS duration_ms, sum(len(selected))::BIGINT AS selected FROM runs GROUP BY 1, 2, 3, 4, 5"""))
def read_runs(lake: Lake) -> DataFrame:
    return run_source.parse_runs(run_lines(lake)).groupBy(
        "run_id", "status", "ok", "error_kind", "turn_index").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms"),
        F.sum(F.size("selected_skills")).alias("selected"))


@query("A1_run_record_problems", sql(b.RUNS_SQL, """
SELECT 'routing/' || run_id AS run_id, 'unknown status' AS problem, count(*) AS n FROM runs WHERE dis = 9 GROUP BY 1"""))
def run_record_problems(lake: Lake) -> DataFrame:
    odd = run_lines(lake).withColumn("value", F.replace("value", F.lit('"timeout"'), F.lit('"gone"')))
    return run_source.run_record_problems(run_source.parse_runs(odd)) \
        .groupBy("run_id", "problem").agg(F.count(F.lit(1)).alias("n"))


def case_lines(lake: Lake) -> DataFrame:
    """One line per order: cases, comments, blanks, unknown fields, bad values, broken JSON."""
    kind = F.col("o_orderpriority")
    record = F.to_json(F.struct(
        F.col("case_id").alias("id"), F.col("label").alias("prompt"), F.col("expected").alias("expected_skills"),
        F.when(F.col("kind") == "2-HIGH", "urgent").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("kind") == "3-MEDIUM", 1).alias("colour"), "tags", "expect_artifacts"))
    rows = b.cases(lake).join(lake.orders.select("o_orderkey", kind.alias("kind")), "o_orderkey")
    value = F.when(F.col("dataset") == "P", F.concat(F.lit("# "), record)) \
        .when(F.col("kind") == "5-LOW", F.substring(record, 2, 50)).otherwise(record)
    return rows.select(F.concat(F.lit("data/"), "dataset", F.lit(".jsonl")).alias("file_path"),
                       F.col("o_orderkey").alias("line_no"), value.alias("value"))


@query("A2_read_cases", sql(b.CASES_SQL, """
SELECT 'data/' || dataset || '.jsonl' AS file_path, severity, count(*) AS n, sum(len(expected))::BIGINT AS gold FROM cases
WHERE dataset <> 'P' AND o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') GROUP BY 1, 2"""))
def read_cases(lake: Lake) -> DataFrame:
    cases, _ = case_source.parse_cases(case_lines(lake))
    return cases.groupBy("file_path", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("expected_skills")).alias("gold"))


@query("A2_case_rejects", sql(b.CASES_SQL, """
SELECT o_orderkey AS line_no, CASE o_orderpriority WHEN '2-HIGH' THEN 'unknown severity' WHEN '3-MEDIUM' THEN 'unknown field'
       ELSE 'not a JSON object' END AS problem FROM cases WHERE dataset <> 'P' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW')"""))
def case_rejects(lake: Lake) -> DataFrame:
    _, rejects = case_source.parse_cases(case_lines(lake))
    return rejects.select("line_no", "problem")


# (field, place of its fault, problem): one of these stands in every line; the first is no fault.
CASE_FIELDS = (
    ('"turns": [{"prompt": "q", "reference": null}]', None, None),
    ('"expected_skills": "pdf"', "expected_skills", "wrong type"),
    ('"turns": "oops"', "turns", "wrong type"),
    ('"forbid_artifacts": "maybe"', "forbid_artifacts", "wrong type"),
    ('"turns": [{"prompt": "q"}, {"prompt": "q", "colour": 1}]', "turns[1].colour", "unknown field"),
    ('"turns": [{"files": []}]', "turns[0].prompt", "missing"),
    ('"context": {"messages": [{"role": "robot", "content": "c"}]}', "context.messages[0].role", "unknown value"),
    ('"tags": ["a", 7]', "tags[1]", "wrong type"),
    ('"expect_trajectory": {"argument_assertions": [{"tool": "t", "path": "p", "equals": {}}]}',
     "expect_trajectory.argument_assertions[0].equals", "wrong type"),
    ('"expect_trajectory": {"required_tools": ["a"], "forbidden_tools": ["b", "a"]}', "expect_trajectory.forbidden_tools",
     "tool required and forbidden"),
    ('"turns": [{"prompt": "q", "expect_trajectory": {"required_verification": true}}]',
     "turns[0].expect_trajectory.verification_tools", "no verification tools"),
)


def _cases_of(column: int) -> str:
    return " ".join(f"WHEN {k} THEN '{row[column]}'" for k, row in enumerate(CASE_FIELDS) if row[column])


@query("A2_strict_rejects", f"""
SELECT o_orderkey AS line_no, CASE o_orderkey % {len(CASE_FIELDS)} {_cases_of(1)} END AS "at",
       CASE o_orderkey % {len(CASE_FIELDS)} {_cases_of(2)} END AS problem FROM orders WHERE o_orderkey % {len(CASE_FIELDS)} <> 0""")
def strict_rejects(lake: Lake) -> DataFrame:
    """A line per order, with faults below the top level."""
    fields = F.array(*(F.lit(row[0]) for row in CASE_FIELDS))
    value = F.concat(F.lit('{"id": "ord-'), F.col("o_orderkey").cast("string"), F.lit('", "prompt": "p", '),
                     F.get(fields, (F.col("o_orderkey") % len(CASE_FIELDS)).cast("int")), F.lit("}"))
    _, rejects = case_source.parse_cases(lake.orders.select(
        F.lit("data/strict.jsonl").alias("file_path"), F.col("o_orderkey").alias("line_no"), value.alias("value")))
    return rejects.select("line_no", "at", "problem")


def document_lines(lake: Lake) -> DataFrame:
    """Each document as a file: a comment block, its text by line, and a late comment."""
    status = F.when(F.col("n_chars") % 3 == 0, "# review_status: draft — not read") \
        .when(F.col("n_chars") % 3 == 1, "# review_status: APPROVED — read")
    head = F.array_compact(F.array(F.concat(F.lit("# generator.model: "), F.col("source")), status))
    body = F.transform(F.split("text", "\n"), lambda t: F.concat(F.lit("| "), t))
    late = F.array(F.lit("# review_status: LATE"))
    return lake.documents.select(
        F.concat(F.lit("doc-"), "doc_id").alias("file_path"),
        F.posexplode(F.concat(head, body, late)).alias("line_no", "value"))


@query("A3_read_review_status", """
SELECT 'doc-' || doc_id AS file_path, CASE n_chars % 3 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'APPROVED' END AS review_status FROM documents""")
def read_review_status(lake: Lake) -> DataFrame:
    return case_source.review_status(document_lines(lake))


@query("A3_header_pairs", """
SELECT 'doc-' || doc_id AS file_path, 'generator.model' AS key, source AS value FROM documents
UNION ALL SELECT 'doc-' || doc_id, 'review_status', CASE n_chars % 3 WHEN 0 THEN 'draft — not read' ELSE 'APPROVED — read' END FROM documents WHERE n_chars % 3 <> 2""")
def header_pairs(lake: Lake) -> DataFrame:
    return case_source.header_pairs(document_lines(lake)).select("file_path", "key", "value")


@query("A4_read_run_dim", """
SELECT c_mktsegment || '/' || c_name AS run_id, 'seg-' || c_mktsegment AS suite_id, c_nationkey AS repeats, '>= 0.9' AS top1_gate,
       2 AS skills, c_acctbal < 0 AS mock FROM customer""")
def read_run_dim(lake: Lake) -> DataFrame:
    suite = F.struct(
        F.concat(F.lit("seg-"), "c_mktsegment").alias("suite_id"), F.col("c_nationkey").alias("repeats"),
        F.struct(F.create_map(F.lit("top1"), F.lit(">= 0.9")).alias("gate")).alias("scoring"))
    document = F.to_json(F.struct(
        suite.alias("suite"), F.create_map(F.lit("a"), F.lit("h1"), F.lit("b"), F.lit("h2")).alias("skills"),
        (F.col("c_acctbal") < 0).alias("mock")))
    path = F.concat_ws("/", F.lit("logs"), "c_mktsegment", "c_name", F.lit("config.snapshot"))
    documents = lake.customer.select(path.alias("file_path"), document.alias("value"))
    return run_source.parse_run_dim(documents).select(
        "run_id", "suite.suite_id", "suite.repeats", F.col("suite.scoring.gate")["top1"].alias("top1_gate"),
        F.size("skills").alias("skills"), "mock")


def grading_documents(lake: Lake) -> DataFrame:
    """One grading report per labelled document."""
    rows = b.judged(lake)
    graded = F.array(F.struct(
        F.col("case_id"), F.col("repeat_index"),
        F.array(F.struct(F.col("assertion").alias("text"), F.col("judge_passed").alias("passed"),
                         F.lit("e").alias("evidence"))).alias("expectations"),
        F.array(F.struct(F.col("dimension").alias("dimension"),
                         F.when(~F.col("failed"), F.col("judge_score")).alias("score"),
                         F.lit("e").alias("evidence"))).alias("dimensions")))
    failures = F.array(F.struct("case_id", "repeat_index", F.lit("broken answer").alias("error")))
    document = F.to_json(F.struct(
        F.struct(F.col("judge_id").alias("id"), F.lit("m").alias("model")).alias("judge"),
        F.when(~F.col("failed"), graded).otherwise(F.array().cast(
            "array<struct<case_id: string, repeat_index: int, expectations: array<struct<text: string, "
            "passed: boolean, evidence: string>>, dimensions: array<struct<dimension: string, score: double, "
            "evidence: string>>>>")).alias("graded"),
        F.when(F.col("failed"), failures).alias("judge_failures")))
    return rows.select(
        F.concat_ws("/", F.lit("logs"), "source", "case_id", F.lit("grading.json")).alias("file_path"),
        document.alias("value"))


@query("A5_read_gradings", sql(b.JUDGED_SQL, """
SELECT source || '/' || case_id AS run_id, judge_id, case_id, turn_index, assertion, judge_passed AS passed FROM judged WHERE NOT failed"""))
def read_gradings(lake: Lake) -> DataFrame:
    graded = run_source.graded_runs(run_source.parse_gradings(grading_documents(lake)))
    return run_source.graded_assertions(graded).select(
        "run_id", "judge_id", "case_id", "turn_index", "assertion", "passed")


@query("A5_judge_failures", sql(b.JUDGED_SQL, """
SELECT judge_id, case_id, 'broken answer' AS error FROM judged WHERE failed"""))
def judge_failures(lake: Lake) -> DataFrame:
    return run_source.judge_failures(run_source.parse_gradings(grading_documents(lake))) \
        .select("judge_id", "case_id", "error")


@query("A6_read_trajectory_gradings", sql(b.JUDGED_SQL, """
SELECT judge_id, dimension, count(*) AS n, round(avg(judge_score), 6) AS mean FROM judged WHERE NOT failed GROUP BY 1, 2"""))
def read_trajectory_gradings(lake: Lake) -> DataFrame:
    graded = run_source.graded_runs(run_source.parse_gradings(grading_documents(lake)))
    return run_source.graded_dimensions(graded).groupBy("judge_id", "dimension").agg(
        F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def gold_documents(lake: Lake) -> DataFrame:
    annotation = F.struct(
        F.col("case_id"), F.when(F.col("n_chars") % 2 == 0, 0).alias("repeat_index"),
        F.when(F.col("n_chars") % 5 == 0, "colour").otherwise(F.col("dimension")).alias("dimension"),
        F.col("human_score").alias("score"), F.lit("why").alias("rationale"))
    document = F.to_json(F.struct(
        F.concat(F.lit("cal-"), "doc_id").alias("calibration_id"),
        F.create_map(F.col("dimension"), F.lit("v1")).alias("dimension_versions"),
        F.when(F.col("n_chars") % 7 == 0, F.array(annotation, annotation)).otherwise(F.array(annotation))
        .alias("annotations")))
    return b.judged(lake).select(F.col("case_id").alias("file_path"), document.alias("value"))


@query("A7_read_human_gold", sql(b.JUDGED_SQL, """
SELECT 'cal-' || doc_id AS calibration_id, case_id, 0 AS repeat_index, human_score AS score, CASE WHEN n_chars % 5 <> 0 THEN 'v1' END AS rubric_version,
       CASE WHEN n_chars % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM judged"""))
def read_human_gold(lake: Lake) -> DataFrame:
    return run_source.score_gold(gold_documents(lake)).groupBy(
        "calibration_id", "case_id", "repeat_index", "score", "rubric_version").agg(F.count(F.lit(1)).alias("n"))


@query("A7_gold_problems", sql(b.JUDGED_SQL, """
SELECT 'cal-' || doc_id AS calibration_id, CASE WHEN n_chars % 5 = 0 THEN 'colour' ELSE dimension END AS dimension, 'repeated key' AS problem
FROM judged WHERE n_chars % 7 = 0
UNION ALL SELECT 'cal-' || doc_id, dimension, 'declared, not annotated' FROM judged WHERE n_chars % 5 = 0
UNION ALL SELECT 'cal-' || doc_id, 'colour', 'annotated, not declared' FROM judged WHERE n_chars % 5 = 0"""))
def gold_problems(lake: Lake) -> DataFrame:
    documents = gold_documents(lake)
    return run_source.gold_problems(
        run_source.score_gold(documents), run_source.declared_dimensions(documents).drop("version"),
        ["case_id", "repeat_index", "turn_index", "dimension"])


@query("A8_read_skill_catalog", """
SELECT CASE WHEN doc_id % 4 = 0 THEN 'dir-' || doc_id ELSE source || '-' || doc_id END AS skill_id, 'v' || (n_chars % 3 + 1) AS version,
       'About ' || lang || ': whole' AS description, lang || '|' || source AS triggers, CASE WHEN doc_id % 2 = 0 THEN 'x y|z' ELSE '' END AS exclusions,
       doc_id % 5 = 0 AS disabled FROM documents""")
def read_skill_catalog(lake: Lake) -> DataFrame:
    key = F.col("doc_id")
    name = F.when(key % 4 == 0, "yes").otherwise(F.concat(F.lit("'"), "source", F.lit("-"), key, F.lit("'")))
    front = F.concat(
        F.lit("---\nname: "), name, F.lit("\ndescription: >-\n  About "), F.col("lang"), F.lit(":\n  whole\ntriggers: ["),
        F.col("lang"), F.lit(", \""), F.col("source"), F.lit("\"]\n"),
        F.when(key % 2 == 0, "exclusions:\n  - x y\n  - 'z'\n").otherwise(""),
        F.when(key % 5 == 0, "enabled: false\n").otherwise(""), F.lit("---\n"), F.col("text"))
    path = F.concat(F.lit("/skills/dir-"), key, F.lit("/v"), F.col("n_chars") % 3 + 1, F.lit("/SKILL.md"))
    files = lake.documents.select(path.alias("path"), front.cast("binary").alias("content"))
    return skill_source.skill_documents(files).select(
        "skill_id", "version", "description", F.array_join("triggers", "|").alias("triggers"),
        F.array_join("exclusions", "|").alias("exclusions"), "disabled")


SESSION_SQL = """
ses AS (SELECT user_id, event_id, event_type, json_extract(props, '$.k')::INT AS k, value FROM events),
evs AS (SELECT user_id, event_id, 0 AS p, 'tool_call' AS event_type, event_type AS tool_name, 'c' || event_id AS call_id, k, 'started' AS status FROM ses WHERE event_type <> 'error'
  UNION ALL SELECT user_id, event_id, 1, 'tool_call', 'extra', NULL, NULL, 'started' FROM ses WHERE event_type = 'view'
  UNION ALL SELECT user_id, event_id, 0, 'tool_result', 'read', 'c' || k, NULL, CASE WHEN value > 50 THEN 'failed' ELSE 'success' END FROM ses WHERE event_type = 'error')"""


@query("A9_read_session_events", sql(SESSION_SQL, """
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id, p) AS INTEGER) AS step_index, event_type, tool_name, call_id, k, status FROM evs"""))
def read_session_events(lake: Lake) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    block = F.struct(
        F.lit(" toolCall ").alias("type"), F.concat(F.lit("c"), F.col("event_id")).alias("id"),
        kind.alias("name"), F.struct(k.alias("k"), F.lit("hide").alias("token")).alias("arguments"))
    extra = F.struct(
        F.lit("tool").alias("type"), F.lit(None).cast("string").alias("id"), F.lit("skip").alias("name"),
        F.struct(k.alias("k"), F.lit("hide").alias("token")).alias("arguments"))
    second = F.struct(
        F.lit("functionCall").alias("type"), F.lit(None).cast("string").alias("id"), F.lit("extra").alias("name"),
        F.lit(None).cast("struct<k: int, token: string>").alias("arguments"))
    call = F.struct(F.lit("assistant").alias("role"),
                    F.when(kind == "view", F.array(block, extra, second)).otherwise(F.array(extra, block)).alias("content"))
    result = F.struct(
        F.lit("toolResult").alias("role"), F.lit("read").alias("toolName"), F.concat(F.lit("c"), k).alias("toolCallId"),
        F.when(F.col("value") > 50, True).alias("isError"), F.lit(7).alias("timestamp"))
    value = F.when(kind == "error", F.to_json(F.struct(F.lit("message").alias("type"), result.alias("message")))) \
        .otherwise(F.to_json(F.struct(F.lit("message").alias("type"), call.alias("message"))))
    lines = lake.events.select("user_id", (2 * F.col("event_id")).alias("line_no"), value.alias("value"))
    noise = lake.events.select("user_id", (2 * F.col("event_id") + 1).alias("line_no"), F.lit("{broken").alias("value"))
    events = sessions.session_events(lines.unionByName(noise), ["user_id"])
    return events.select("user_id", "step_index", "event_type", "tool_name", "call_id",
                         F.try_variant_get("arguments", "$.k", "int").alias("k"), "status")


@query("A10_file_manifest", """
SELECT CASE WHEN doc_id % 3 = 0 THEN 'sub/_meta.json' || doc_id ELSE 'a/' || doc_id || '.md' END AS path, sha256(text) AS sha256,
       octet_length(encode(text))::BIGINT AS size_bytes FROM documents WHERE source <> 'src1'""")
def file_manifest(lake: Lake) -> DataFrame:
    key = F.col("doc_id")
    name = F.when(F.col("source") == "src1", F.concat(F.lit(".git/"), key)) \
        .when(key % 3 == 0, F.concat(F.lit("sub/_meta.json"), key)).otherwise(F.concat(F.lit("a/"), key, F.lit(".md")))
    files = lake.documents.select(
        F.concat(F.lit("file:/data/skill/"), name).alias("path"), F.col("text").cast("binary").alias("content"))
    return skill_source.manifest_of(files, "/data/skill")


@query("A10_manifest_digest", """
SELECT lang, count(*) AS files, 1::BIGINT AS digests FROM documents GROUP BY 1""")
def manifest_digest(lake: Lake) -> DataFrame:
    """The digest of a set does not depend on the order or split of its rows."""
    manifest = lake.documents.select("lang", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    both = skill_source.manifest_digest(manifest, ["lang"]).unionByName(
        skill_source.manifest_digest(manifest.orderBy(F.desc("path")), ["lang"]))
    return both.groupBy("lang").agg(F.max("files").alias("files"), F.count_distinct("set_digest").alias("digests"))


@query("A11_write_scores", sql(b.SCORES_SQL, "SELECT * FROM scores"))
def write_scores(lake: Lake) -> DataFrame:
    folder = new_folder(lake.spark, "scores")
    run_source.write_scores(b.scores(lake), folder)
    return lake.spark.read.parquet(folder).select("run_id", "metric", "value")


@query("A12_trajectory_projection", sql(b.RUNS_SQL, """
SELECT run_id, status, error_kind, count(*) AS n, sum(CASE WHEN tax IN (3, 4) THEN 0 ELSE 2 END + (l_quantity >= 10)::INT + 1)::BIGINT AS events
FROM runs GROUP BY 1, 2, 3"""))
def trajectory_projection(lake: Lake) -> DataFrame:
    rows = b.runs(lake).withColumn("exact_events", F.lit(None).cast(f"array<{EVENT}>"))
    projected = run_source.trajectory_projection(trajectory.normalize_trajectory(rows))
    return projected.groupBy("run_id", "status", "error_kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("events")).alias("events"))


@query("A13_latest_run", """
SELECT arg_max('orders/' || o_orderkey, (o_orderdate, 'logs/orders/' || o_orderkey || '/runs.jsonl')) AS run_id, CAST(epoch(max(o_orderdate)) AS BIGINT) AS modified_at FROM orders""")
def latest_run(lake: Lake) -> DataFrame:
    files = lake.orders.select(
        F.concat(F.lit("logs/orders/"), "o_orderkey", F.lit("/runs.jsonl")).alias("path"),
        F.col("o_orderdate").alias("modificationTime"))
    return run_source.newest(files).withColumn("modified_at", F.unix_timestamp("modified_at"))
