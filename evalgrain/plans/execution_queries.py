"""Queries on full execution: turns, conversations, files, failure evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalgrain.functions import files
from evalgrain.functions.cases import case_stage
from evalgrain.functions.text import case_type
from evalgrain.operators import evidence, execution, joins
from evalgrain.plans import bindings as b, report
from evalgrain.plans.bindings import Lake
from evalgrain.plans.catalog import query, sql

KEPT_SQL = """
bad AS (SELECT DISTINCT run_id, case_id, repeat_index FROM turns WHERE error_kind IN ('runtime', 'network', 'harness')),
kept AS (SELECT * FROM turns t WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.run_id = t.run_id AND bad.case_id = t.case_id
                                                 AND bad.repeat_index = t.repeat_index)),
ex AS (SELECT * FROM kept WHERE NOT skipped),
conv AS (SELECT run_id, case_id, repeat_index, bool_and(done) AS done, arg_min(severity, turn_index) AS severity,
                arg_min(type, turn_index) AS type, arg_min(stage, turn_index) AS stage, max(turn_index) AS max_turn FROM kept GROUP BY 1, 2, 3),
sess AS (SELECT run_id, case_id, repeat_index, max(turn_index) AS max_turn, count(DISTINCT turn_index) AS turn_count,
                count(DISTINCT session_id) AS sessions FROM ex GROUP BY 1, 2, 3)"""

KEPT = (b.TURNS_SQL, KEPT_SQL)


@b.shared
def kept(lake: Lake) -> DataFrame:
    return joins.drop_system_conversations(b.turns(lake))


@query("C4_drop_system_conversations", sql(*KEPT, """
SELECT run_id, count(DISTINCT case_id) AS cases, count(*) AS n FROM kept GROUP BY run_id"""))
def drop_system_conversations(lake: Lake) -> DataFrame:
    return kept(lake).groupBy("run_id").agg(
        F.count_distinct("case_id").alias("cases"), F.count(F.lit(1)).alias("n"))


SCORED_SQL = """
art AS (SELECT r.*, c.label, c.kind, c.o_orderstatus, c.stage, c.severity, c.expected, c.type,
  CASE WHEN l_quantity < 10 THEN NULL ELSE 'out/' || l_returnflag || '-' || l_linenumber || '.csv' END AS path,
  CASE WHEN l_quantity < 14 THEN 0 ELSE l_suppkey + 1 END AS size,
  CASE WHEN tax = 0 THEN 'text/plain' WHEN tax > 2 THEN 'text/csv' END AS mime,
  CASE WHEN tax = 3 OR tax = 4 THEN [] ELSE ['tool_' || l_returnflag, 'read'] END AS tools
  FROM runs r JOIN cases c ON r.case_id = c.case_id),
scored AS (SELECT *, path IS NOT NULL AND size > 0 AND (mime IS NULL OR mime = 'text/csv') AS good FROM art),
hit AS (SELECT *, CASE kind WHEN 'pos' THEN (good AND path LIKE 'out/' || label || '-%.csv')::INT
    WHEN 'multi' THEN good::INT + (good AND regexp_matches(path, '^out/[A-N]-.\\.csv$'))::INT ELSE 0 END AS art_hits,
  CASE kind WHEN 'pos' THEN 1 WHEN 'multi' THEN 2 ELSE 0 END AS art_total,
  CASE WHEN o_orderstatus = 'O' THEN list_contains(tools, 'read')::INT + list_contains(tools, 'tool_' || label)::INT ELSE 0 END AS tool_hits,
  CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS tool_total,
  CASE WHEN o_orderstatus = 'F' THEN (l_linenumber % 2 = 0)::INT ELSE 0 END AS workspace_hits,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS workspace_total,
  list_has_all([l_returnflag, l_linestatus], expected) AND list_has_all(['A', 'N', 'F'], expected) AS skill_injected
  FROM scored),
st AS (SELECT *, ok AND art_hits = art_total AND tool_hits = tool_total AND workspace_hits = workspace_total
              AND NOT (kind = 'rej' AND path IS NOT NULL) AS done FROM hit)"""

SCORED = (b.CASES_SQL, b.RUNS_SQL, SCORED_SQL)


@b.shared
def expectations(lake: Lake) -> DataFrame:
    """Expectations of turn 1 with compiled patterns; stage and type come with the case."""
    c = b.cases(lake)
    stage = case_stage(F.col("stage"), F.col("tags"),
                       (F.size("expect_artifacts") > 0) | F.col("forbid_artifacts"),
                       F.size("expect_tools") > 0)
    return execution.compile_expectations(c).select(
        "case_id", F.lit(1).alias("turn_index"), case_type(F.col("case_id")).alias("type"),
        stage.alias("stage"), "severity", F.col("expected").alias("expected_skills"),
        "expect_artifacts", "expect_workspace_files", "artifact_rules", "workspace_rules",
        "tool_rules", "forbid_artifacts", F.lit(False).alias("requires_context"))


@b.shared
def scored(lake: Lake) -> DataFrame:
    rows = joins.runs_with_case(execution.scored_part(b.runs(lake)), expectations(lake))
    return execution.score_turns(rows.withColumn("catalog", b.strings("A", "N", "F")))


@query("E1_score_turn", sql(*SCORED, """
SELECT run_id, type, sum(art_hits)::BIGINT AS art_hits, sum(art_total)::BIGINT AS art_total, sum(tool_hits)::BIGINT AS tool_hits,
       sum(tool_total)::BIGINT AS tool_total, sum(workspace_hits)::BIGINT AS workspace_hits, count(*) FILTER (WHERE done) AS done,
       count(*) FILTER (WHERE path IS NOT NULL) AS artifacts, count(*) AS n FROM st GROUP BY 1, 2"""))
def score_turn(lake: Lake) -> DataFrame:
    return scored(lake).groupBy("run_id", "type").agg(
        *[F.sum(c).alias(c) for c in ("art_hits", "art_total", "tool_hits", "tool_total", "workspace_hits")],
        F.count_if("done").alias("done"), F.sum("n_artifacts").alias("artifacts"),
        F.count(F.lit(1)).alias("n"))


@query("E2_skill_injected", sql(*SCORED, """
SELECT run_id, avg(skill_injected::INT) AS skill_injected FROM st GROUP BY run_id"""))
def skill_injected(lake: Lake) -> DataFrame:
    return execution.turn_scores(scored(lake)).select("run_id", "skill_injected")


@query("E3_conversations", sql(*KEPT, """
SELECT conv.run_id, conv.case_id, conv.repeat_index, 0::BIGINT AS occurrence, conv.done, conv.severity, conv.max_turn,
       coalesce(sess.sessions = 1, false) AS one_session, coalesce(turn_count, 0)::BIGINT AS executed_turns
FROM conv LEFT JOIN sess USING (run_id, case_id, repeat_index)"""))
def conversations(lake: Lake) -> DataFrame:
    return execution.conversations(kept(lake)).select(
        "run_id", "case_id", "repeat_index", "occurrence", "done", "severity", "max_turn", "one_session",
        "executed_turns")


@query("E3_occurrences", sql(*SCORED, """
SELECT run_id, occurrence, count(*) AS conversations, count(*) FILTER (WHERE done) AS done FROM (
  SELECT run_id, case_id, repeat_index, row_number() OVER (PARTITION BY run_id, case_id, repeat_index, turn_index ORDER BY line_no) - 1 AS occurrence, done
  FROM st) x GROUP BY 1, 2"""))
def occurrences(lake: Lake) -> DataFrame:
    return execution.conversations(scored(lake)).groupBy("run_id", "occurrence").agg(
        F.count(F.lit(1)).alias("conversations"), F.count_if("done").alias("done"))


FULL_SCORES_SQL = """
a AS (SELECT run_id, avg(done::INT) AS task_completion, 1 - avg(CASE WHEN severity = 'critical' THEN done::INT END) AS critical_miss FROM conv GROUP BY 1),
s AS (SELECT run_id, avg(CASE WHEN turn_count > 1 THEN (sessions = 1 AND turn_count = max_turn)::INT END) AS session_continuity FROM sess GROUP BY 1),
t AS (SELECT run_id, avg(done::INT) AS turn_completion, sum(art_hits)::DOUBLE / nullif(sum(art_total), 0) AS artifact_hit,
   sum(tool_hits)::DOUBLE / nullif(sum(tool_total), 0) AS tool_hit, avg(CASE WHEN requires_context THEN done::INT END) AS context_retention,
   sum(CASE WHEN turn_index > 1 THEN workspace_hits END)::DOUBLE / nullif(sum(CASE WHEN turn_index > 1 THEN workspace_total END), 0) AS file_state_continuity
   FROM ex GROUP BY 1),
full_wide AS (SELECT a.run_id, task_completion, turn_completion, artifact_hit, tool_hit, session_continuity, context_retention,
   file_state_continuity, critical_miss FROM a LEFT JOIN s ON a.run_id = s.run_id LEFT JOIN t ON a.run_id = t.run_id)"""


@query("E4_E11_execution_scores", sql(*KEPT, FULL_SCORES_SQL, "SELECT * FROM full_wide"))
def execution_scores(lake: Lake) -> DataFrame:
    return execution.scores(kept(lake)).select("run_id", *execution.METRICS)


def _one_metric(metric: str):
    @query(f"E_{metric}", sql(*KEPT, FULL_SCORES_SQL, f"SELECT run_id, {metric} FROM full_wide"))
    def run(lake: Lake) -> DataFrame:
        source = execution.conversation_scores(execution.conversations(kept(lake))) \
            if metric in ("task_completion", "session_continuity", "critical_miss") \
            else execution.turn_scores(kept(lake))
        return source.select("run_id", metric)

    return run


for _metric in execution.METRICS:
    _one_metric(_metric)


@query("E12_completion_by_type", sql(*KEPT, """
SELECT run_id, type, count(*) AS runs, avg(done::INT) AS completion FROM conv GROUP BY 1, 2"""))
def completion_by_type(lake: Lake) -> DataFrame:
    return execution.completion_by(execution.case_repeats(kept(lake)), "type")


@query("E12_completion_by_stage", sql(*KEPT, """
SELECT run_id, stage, count(*) AS runs, avg(done::INT) AS completion FROM conv GROUP BY 1, 2"""))
def completion_by_stage(lake: Lake) -> DataFrame:
    return execution.completion_by(execution.case_repeats(kept(lake)), "stage")


@query("E13_per_case", sql(*KEPT, """
SELECT c.run_id, c.case_id, c.conversations, c.done, c.turns, t.* EXCLUDE (run_id, case_id) FROM
 (SELECT run_id, case_id, count(*) AS conversations, avg(done::INT) AS done, max(max_turn) AS turns FROM conv GROUP BY 1, 2) c
 LEFT JOIN (SELECT run_id, case_id, count(*) AS turn_runs, avg(done::INT) AS turn_completion, avg(skill_injected::INT) AS injected,
   sum(art_hits)::BIGINT AS art_hits, sum(art_total)::BIGINT AS art_total, sum(tool_hits)::BIGINT AS tool_hits, sum(tool_total)::BIGINT AS tool_total,
   sum(workspace_hits)::BIGINT AS workspace_hits, sum(workspace_total)::BIGINT AS workspace_total, avg(n_artifacts) AS files FROM ex GROUP BY 1, 2) t
 ON c.run_id = t.run_id AND c.case_id = t.case_id"""))
def per_case(lake: Lake) -> DataFrame:
    return execution.per_case(kept(lake))


@query("E14_per_turn", sql(*KEPT, """
SELECT run_id, case_id, turn_index, count(*) AS runs, avg(done::INT) AS completion, sum(art_hits)::BIGINT AS art_hits, sum(art_total)::BIGINT AS art_total,
       sum(tool_hits)::BIGINT AS tool_hits, sum(tool_total)::BIGINT AS tool_total, sum(workspace_hits)::BIGINT AS workspace_hits,
       sum(workspace_total)::BIGINT AS workspace_total FROM ex GROUP BY 1, 2, 3"""))
def per_turn(lake: Lake) -> DataFrame:
    return execution.per_turn(kept(lake))


@query("E15_full_run_counts", sql(b.TURNS_SQL, """
SELECT run_id, count(DISTINCT case_id) AS cases, count(DISTINCT (case_id, repeat_index)) AS conversations, count(*) AS turns,
       count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE error_kind = 'runtime') AS runtime_failures,
       count(*) FILTER (WHERE error_kind = 'network') AS network_failures, count(*) FILTER (WHERE error_kind = 'harness') AS harness_failures
FROM turns GROUP BY run_id"""))
def full_run_counts(lake: Lake) -> DataFrame:
    return execution.run_counts(b.turns(lake))


@query("E16_skip_propagation", sql(b.TURNS_SQL, """
SELECT run_id, case_id, turn_index, status, CASE WHEN turn_index > first_bad THEN 'skipped' ELSE status END AS expected_status,
       CASE WHEN turn_index > first_bad THEN 'turn ' || first_bad || ' came before and was failed' END AS expected_reason
FROM (SELECT *, min(CASE WHEN status = 'failed' THEN turn_index END) OVER (PARTITION BY run_id, case_id, repeat_index) AS first_bad FROM turns) x"""))
def skip_propagation(lake: Lake) -> DataFrame:
    return execution.skip_propagation(b.turns(lake)).select(
        "run_id", "case_id", "turn_index", "status", "expected_status", "expected_reason")


@query("execution_report", sql(*KEPT, FULL_SCORES_SQL, """
SELECT run_id, metric, value FROM (UNPIVOT (SELECT * FROM full_wide) ON COLUMNS(* EXCLUDE run_id) INTO NAME metric VALUE value)
UNION ALL SELECT run_id, unnest(['pass_at_k', 'pass_all_k']), unnest([avg(done::INT), avg(done::INT)]) FROM conv GROUP BY run_id"""))
def execution_report(lake: Lake) -> DataFrame:
    return report.execution_scores(b.turns(lake), 1)


@query("L2_full_failures", sql(*SCORED, """
SELECT run_id, metric, count(*) AS n FROM (
  SELECT run_id, CASE WHEN NOT done THEN 'task_completion' WHEN dis < 2 THEN 'assertion' END AS metric FROM st
  WHERE coalesce(error_kind, '') NOT IN ('runtime', 'network', 'harness')) x WHERE metric IS NOT NULL GROUP BY 1, 2"""))
def full_failures(lake: Lake) -> DataFrame:
    discount = F.round(F.col("l_discount") * 100).cast("int")
    verdict = F.array(F.struct(
        F.lit("claim").alias("text"), (discount != 0).alias("passed"), F.lit("seen").alias("evidence")))
    scores = F.array(F.struct(
        F.lit("relevancy").alias("dimension"), F.when(discount == 1, 0.5).otherwise(0.75).alias("score"),
        F.lit("seen").alias("evidence")))
    gradings = lake.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity",
        F.concat(F.lit("run-"), "l_linestatus").alias("run_id"),
        (F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("bigint") * 10000000
         + F.col("l_partkey")).alias("line_no"),
        verdict.alias("expectations"), scores.alias("dimensions"))
    on = ["run_id", "line_no", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
          "l_quantity"]
    runs = execution.scored_part(b.runs(lake)).withColumn("selected_skills", F.col("selected"))
    rows = joins.runs_with_case(runs, expectations(lake))
    return evidence.full_failures(rows, gradings, on).groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("n"))


@query("C3_runs_with_grading", sql(b.TURNS_SQL, """
SELECT run_id, role = 'assistant' AND length(text) > 100 AS graded, count(*) AS n FROM turns GROUP BY 1, 2"""))
def runs_with_grading(lake: Lake) -> DataFrame:
    turns = b.turns(lake)
    graded = turns.filter("role = 'assistant' AND length(text) > 100") \
        .select(*joins.RUN_KEY, F.lit(1).alias("passed"))
    return joins.runs_with_grading(turns, graded).groupBy(
        "run_id", F.col("passed").isNotNull().alias("graded")).agg(F.count(F.lit(1)).alias("n"))


# --- files --------------------------------------------------------------------

PATHS_SQL = r"""
pth AS (SELECT page_id, length(html) AS size, regexp_replace(url, '^https?://', '') AS path FROM pages)"""


def paths(lake: Lake) -> DataFrame:
    return lake.pages.select(
        "page_id", F.length("html").alias("size"), F.regexp_replace("url", "^https?://", "").alias("path"))


@query("B7_artifact_hit", sql(PATHS_SQL, """
SELECT page_id, size > 2000 AND path LIKE '%.example.%/__/%.html' AS hit,
       CASE WHEN path LIKE '%.html' THEN 'text/html' END AS mime FROM pth"""))
def artifact_hit(lake: Lake) -> DataFrame:
    pattern = F.lit("*.example.*/??/*.html")
    artifact = F.array(F.struct(
        F.col("path").alias("path"), F.when(F.col("size") > 2000, F.col("size")).otherwise(0).alias("size_bytes"),
        F.lit("text/html").alias("mime_type")))
    guessed = F.when(F.col("path").endswith(".html"), files.guess_mime(F.col("path")))
    return paths(lake).select(
        "page_id", files.artifact_hit(files.glob_regex(pattern), files.guess_mime(pattern), artifact).alias("hit"),
        guessed.alias("mime"))


@query("B8_workspace_hit", sql(PATHS_SQL, r"""
SELECT page_id, regexp_matches(path, '^[bm]\..*') AS set_hit, regexp_matches(path, '^[^w].*\.(com|org)/') AS not_set_hit,
       path LIKE '%?page=2%' AS literal_hit FROM pth"""))
def workspace_hit(lake: Lake) -> DataFrame:
    def hit(*patterns: str):
        found = F.lit(False)
        for p in patterns:
            found = found | files.workspace_hit(files.glob_regex(F.lit(p)), F.array("path"))
        return found

    return paths(lake).select(
        "page_id", hit("[bm].*").alias("set_hit"), hit("[!w]*.com/*", "[!w]*.org/*").alias("not_set_hit"),
        hit("*[?]page=2*").alias("literal_hit"))


FILES_SQL = """
old AS (SELECT l_orderkey AS path, count(*) AS size_bytes, max(l_shipdate) AS mtime FROM lineitem GROUP BY 1),
new AS (SELECT o_orderkey AS path, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 5 ELSE size_bytes END AS size_bytes,
               mtime, o_orderstatus FROM orders LEFT JOIN old ON o_orderkey = old.path)"""


def snapshots(lake: Lake) -> tuple[DataFrame, DataFrame]:
    """Before: one file per order with lines. After: one per order; some sizes differ, some are state."""
    lines = lake.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("size_bytes"), F.max("l_shipdate").alias("mtime"))
    before = lines.select(F.concat(F.lit("out/"), "l_orderkey").alias("path"), "mtime", "size_bytes")
    priority = F.col("o_orderpriority")
    after = lake.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.when(F.col("o_orderstatus") == "P", ".git/").otherwise("out/"), "o_orderkey").alias("path"),
        "mtime",
        F.when(priority == "1-URGENT", 4).when(priority == "2-HIGH", 5).otherwise(F.col("size_bytes"))
        .alias("size_bytes"))
    return before, after


@query("C8_artifact_diff", sql(FILES_SQL, """
SELECT 'out/' || new.path AS path, new.size_bytes::BIGINT AS size_bytes, CASE WHEN old.path IS NULL THEN 'created' ELSE 'modified' END AS change
FROM new LEFT JOIN old ON new.path = old.path
WHERE o_orderstatus <> 'P' AND (old.path IS NULL OR new.size_bytes IS DISTINCT FROM old.size_bytes)"""))
def artifact_diff(lake: Lake) -> DataFrame:
    before, after = snapshots(lake)
    return joins.artifact_diff(before, after).select("path", "size_bytes", "change")


@query("C9_workspace_listing", """
SELECT DISTINCT 'run-' || l_linestatus AS run_id, CASE WHEN l_linenumber = 7 THEN 'AGENTS.md' ELSE 'out/' || l_suppkey END AS path
FROM lineitem WHERE l_returnflag <> 'R'""")
def workspace_listing(lake: Lake) -> DataFrame:
    manifest = lake.lineitem.select(
        F.concat(F.lit("run-"), "l_linestatus").alias("run_id"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("out/.git/"), "l_suppkey"))
        .when(F.col("l_linenumber") == 7, "AGENTS.md").otherwise(F.concat(F.lit("out/"), "l_suppkey")).alias("path"))
    return joins.workspace_files(manifest, ["run_id"])


@query("C14_retention_plan", """
WITH sel AS (SELECT s_suppkey AS owner FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
             WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA')),
own AS (SELECT DISTINCT l_orderkey AS path, l_suppkey AS owner FROM lineitem),
p AS (SELECT path, count(*) AS owners, count(sel.owner) AS selected_owners FROM own LEFT JOIN sel ON own.owner = sel.owner GROUP BY 1)
SELECT path, owners, selected_owners, CASE WHEN o_orderstatus = 'P' THEN 'retain_tracked' WHEN owners = selected_owners THEN 'remove_after_verify'
       ELSE 'retain_shared' END AS action FROM p JOIN orders ON o_orderkey = path WHERE selected_owners > 0""")
def retention_plan(lake: Lake) -> DataFrame:
    owners = lake.lineitem.select(
        F.col("l_orderkey").alias("path"), F.col("l_suppkey").alias("owner")).distinct()
    regions = lake.region.filter(F.col("r_name").isin("ASIA", "EUROPE", "AMERICA"))
    selected = lake.supplier.join(lake.nation, F.col("s_nationkey") == F.col("n_nationkey")) \
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi") \
        .select(F.col("s_suppkey").alias("owner"))
    tracked = lake.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path"))
    return joins.retention_plan(owners, selected, tracked)


@query("C14_propagate_owners", """
WITH ds AS (SELECT DISTINCT l_orderkey AS dataset, l_suppkey AS owner FROM lineitem),
refs AS (SELECT o_orderkey AS dataset, 'cust-' || o_custkey AS path FROM orders),
expl AS (SELECT 'cust-' || c_custkey AS path, c_nationkey::BIGINT AS owner FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT DISTINCT path, owner FROM (
  SELECT refs.path, ds.owner FROM refs JOIN ds USING (dataset) WHERE refs.path NOT IN (SELECT path FROM expl)
  UNION ALL SELECT 'order-' || dataset, owner FROM ds UNION ALL SELECT path, owner FROM expl) x""")
def propagate_owners(lake: Lake) -> DataFrame:
    # Numbers are made distinct, not the longer texts.
    owners = lake.lineitem.select("l_orderkey", "l_suppkey").distinct().select(
        F.concat(F.lit("order-"), "l_orderkey").alias("dataset"), F.col("l_suppkey").alias("owner"))
    references = lake.orders.select(
        F.concat(F.lit("order-"), "o_orderkey").alias("dataset"),
        F.concat(F.lit("cust-"), "o_custkey").alias("path"), F.lit("suite").alias("category"))
    explicit = lake.customer.filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("cust-"), "c_custkey").alias("path"), F.col("c_nationkey").cast("bigint").alias("owner"))
    return joins.propagate_owners(owners, references, explicit)


@query("C15_missing_inputs", """
SELECT 'doc-' || doc_id AS case_id, doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_inputs(lake: Lake) -> DataFrame:
    declared = lake.documents.select(
        F.concat(F.lit("doc-"), "doc_id").alias("case_id"), F.col("doc_id").alias("path"))
    return joins.missing_inputs(declared, lake.labels.select(F.col("doc_id").alias("path")))


@query("C16_restore_plan", """
SELECT d.doc_id AS path, CASE WHEN l.doc_id IS NULL THEN 'restore' WHEN l.quality = 1 THEN 'reuse' ELSE 'collision' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def restore_plan(lake: Lake) -> DataFrame:
    manifest = lake.documents.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("x")), 256))
    current = lake.labels.join(lake.documents.select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("path"), changed.alias("sha256"))
    return joins.restore_plan(manifest, current).select("path", "status")
