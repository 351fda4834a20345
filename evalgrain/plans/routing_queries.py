"""Queries on routing, reliability, cost, gates and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import cases as case_functions, text, usage
from evalgrain.operators import (
    compare, evidence, gates, inspection, joins, ordered, plugins, routing, stats,
)
from evalgrain.plans import bindings as b, report
from evalgrain.plans.bindings import Lake
from evalgrain.plans.catalog import query, sql
from evalgrain.schemas import RUBRICS

ROUTED_SQL = """
routed AS (
  SELECT r.run_id, r.case_id, r.repeat_index, r.line_no, r.ok, r.error_kind, c.type, c.stage, c.severity,
         c.expected, r.selected,
         list_sort(list_distinct(c.expected)) = list_sort(list_distinct(r.selected)) AS exact,
         len(list_distinct(c.expected)) AS n_expected,
         coalesce(c.expected[1], '∅') AS truth, coalesce(r.selected[1], '∅') AS predicted
  FROM runs r JOIN cases c ON r.case_id = c.case_id
), jd AS (SELECT * FROM routed WHERE ok)"""

ROUTED = (b.CASES_SQL, b.RUNS_SQL, ROUTED_SQL)


@b.shared
def routed(lake: Lake) -> DataFrame:
    return report.routing_rows(b.runs(lake), b.cases(lake))


@b.shared
def judged(lake: Lake) -> DataFrame:
    return routing.judge(routed(lake))


@b.shared
def run_dim(lake: Lake) -> DataFrame:
    """One row per run, with a third run that left no record."""
    gate = F.create_map(*[F.lit(x) for x in (
        "exact_set_match", ">= 0.25", "critical_miss", "<= 0.9", "type_rej", ">= 0.2",
        "assertion_pass_rate", ">= 0.8")])
    named = b.runs(lake).select("run_id").distinct()
    empty = lake.region.filter("r_name = 'ASIA'").select(F.lit("run-empty").alias("run_id"))
    return named.unionByName(empty).select("run_id", gate.alias("gate"), F.lit(False).alias("mock"))


RUN_DIM_SQL = """
gate AS (SELECT * FROM (VALUES ('exact_set_match', '>= 0.25', '>=', 0.25e0), ('critical_miss', '<= 0.9', '<=', 0.9e0),
  ('type_rej', '>= 0.2', '>=', 0.2e0), ('assertion_pass_rate', '>= 0.8', '>=', 0.8e0)) g(metric, condition, op, threshold)),
dim AS (SELECT DISTINCT run_id FROM runs UNION ALL SELECT 'run-empty' FROM region WHERE r_name = 'ASIA')"""

WIDE_SQL = """
wide AS (
  SELECT run_id, avg(exact::INT) AS exact_set_match,
         avg(CASE WHEN n_expected = 1 THEN (truth = predicted)::INT END) AS top1,
         avg(CASE WHEN n_expected > 1 THEN exact::INT END) AS multi_exact,
         avg(CASE WHEN n_expected = 0 THEN exact::INT END) AS no_skill_rejection,
         1 - avg(CASE WHEN n_expected = 0 THEN exact::INT END) AS false_activation,
         1 - avg(CASE WHEN severity = 'critical' THEN exact::INT END) AS critical_miss,
         avg(CASE WHEN type = 'pos' THEN exact::INT END) AS type_pos,
         avg(CASE WHEN type = 'amb' THEN exact::INT END) AS type_amb,
         avg(CASE WHEN type = 'multi' THEN exact::INT END) AS type_multi,
         avg(CASE WHEN type = 'rej' THEN exact::INT END) AS type_rej,
         avg(CASE WHEN stage = 'trigger' THEN exact::INT END) AS stage_trigger,
         avg(CASE WHEN stage = 'logic' THEN exact::INT END) AS stage_logic,
         avg(CASE WHEN stage = 'artifact' THEN exact::INT END) AS stage_artifact,
         avg(CASE WHEN stage = 'failure' THEN exact::INT END) AS stage_failure
  FROM jd GROUP BY run_id
)"""


@query("D1_D6_routing_scores", sql(*ROUTED, WIDE_SQL, "SELECT * FROM wide"))
def routing_scores(lake: Lake) -> DataFrame:
    return routing.scores(judged(lake))


@query("D1_exact_set_match", sql(*ROUTED, """
SELECT run_id, count(*) AS n, sum(exact::INT)::BIGINT AS hits, avg(exact::INT) AS exact_set_match FROM jd GROUP BY run_id"""))
def exact_set_match(lake: Lake) -> DataFrame:
    return judged(lake).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("hits"),
        F.avg(F.col("exact").cast("double")).alias("exact_set_match"))


@query("D2_top1", sql(*ROUTED, WIDE_SQL, "SELECT run_id, top1 FROM wide"))
def top1(lake: Lake) -> DataFrame:
    return routing.scores(judged(lake)).select("run_id", "top1")


@query("D3_multi_exact", sql(*ROUTED, WIDE_SQL, "SELECT run_id, multi_exact FROM wide"))
def multi_exact(lake: Lake) -> DataFrame:
    return routing.scores(judged(lake)).select("run_id", "multi_exact")


@query("D4_no_skill_rejection", sql(*ROUTED, WIDE_SQL, "SELECT run_id, no_skill_rejection FROM wide"))
def no_skill_rejection(lake: Lake) -> DataFrame:
    return routing.scores(judged(lake)).select("run_id", "no_skill_rejection")


@query("D5_false_activation", sql(*ROUTED, WIDE_SQL, "SELECT run_id, false_activation FROM wide"))
def false_activation(lake: Lake) -> DataFrame:
    return routing.scores(judged(lake)).select("run_id", "false_activation")


@query("D6_critical_miss", sql(*ROUTED, WIDE_SQL, "SELECT run_id, critical_miss FROM wide"))
def critical_miss(lake: Lake) -> DataFrame:
    return routing.scores(judged(lake)).select("run_id", "critical_miss")


@query("D7_by_type", sql(*ROUTED, """
SELECT run_id, type, count(*) AS runs, avg(exact::INT) AS accuracy FROM jd GROUP BY run_id, type"""))
def by_type(lake: Lake) -> DataFrame:
    return routing.by_type(judged(lake))


@query("D8_by_stage", sql(*ROUTED, """
SELECT run_id, stage, count(*) AS runs, avg(exact::INT) AS accuracy FROM jd GROUP BY run_id, stage"""))
def by_stage(lake: Lake) -> DataFrame:
    return routing.by_stage(judged(lake))


MATRIX_SQL = """
cells AS (SELECT run_id, truth, predicted, count(*) AS n FROM jd WHERE n_expected <= 1 GROUP BY 1, 2, 3)"""


@query("D9_per_skill_prf", sql(*ROUTED, MATRIX_SQL, """,
lab AS (SELECT run_id, truth AS label FROM cells UNION SELECT run_id, predicted FROM cells),
tp AS (SELECT run_id, truth AS label, sum(n) AS v FROM cells WHERE truth = predicted GROUP BY 1, 2),
t AS (SELECT run_id, truth AS label, sum(n) AS v FROM cells GROUP BY 1, 2),
p AS (SELECT run_id, predicted AS label, sum(n) AS v FROM cells GROUP BY 1, 2)
SELECT lab.run_id, lab.label, coalesce(coalesce(tp.v, 0)::DOUBLE / nullif(p.v, 0), 0) AS precision,
       coalesce(coalesce(tp.v, 0)::DOUBLE / nullif(t.v, 0), 0) AS recall,
       coalesce(2 * coalesce(tp.v, 0)::DOUBLE / (coalesce(p.v, 0) + coalesce(t.v, 0)), 0) AS f1,
       coalesce(t.v, 0)::BIGINT AS support
FROM lab LEFT JOIN tp USING (run_id, label) LEFT JOIN t USING (run_id, label) LEFT JOIN p USING (run_id, label)
"""))
def per_skill_prf(lake: Lake) -> DataFrame:
    return routing.per_label(routing.confusion_matrix(judged(lake)))


@query("D10_confusion_matrix", sql(*ROUTED, MATRIX_SQL, "SELECT * FROM cells"))
def confusion_matrix(lake: Lake) -> DataFrame:
    return routing.confusion_matrix(judged(lake))


@query("D10_dense_confusion", sql(*ROUTED, MATRIX_SQL, """
SELECT r.run_id, l.truth, coalesce(sum(CASE WHEN predicted = 'A' THEN n END), 0)::BIGINT AS "A", coalesce(sum(CASE WHEN predicted = 'N' THEN n END), 0)::BIGINT AS "N",
       coalesce(sum(CASE WHEN predicted = 'X' THEN n END), 0)::BIGINT AS "X", coalesce(sum(CASE WHEN predicted = '∅' THEN n END), 0)::BIGINT AS "∅"
FROM (SELECT DISTINCT run_id FROM cells) r CROSS JOIN (VALUES ('A'), ('N'), ('X'), ('∅')) l(truth)
LEFT JOIN cells ON cells.run_id = r.run_id AND cells.truth = l.truth GROUP BY 1, 2"""))
def dense_confusion(lake: Lake) -> DataFrame:
    return routing.dense_confusion(routing.confusion_matrix(judged(lake)), ["A", "N", "X", text.NO_LABEL])


@query("D10_confusion_labels", sql(*ROUTED, MATRIX_SQL, """
SELECT run_id, label, label = '∅' AS is_none FROM
  (SELECT run_id, truth AS label FROM cells UNION SELECT run_id, predicted FROM cells) x"""))
def confusion_labels(lake: Lake) -> DataFrame:
    return routing.confusion_labels(routing.confusion_matrix(judged(lake)))


@query("D10_filled_confusion", sql(*ROUTED, MATRIX_SQL, """
, lab AS (SELECT run_id, truth AS label FROM cells UNION SELECT run_id, predicted FROM cells)
SELECT a.run_id, a.label AS truth, b.label AS predicted, coalesce(n, 0)::BIGINT AS n
FROM lab a JOIN lab b ON a.run_id = b.run_id
LEFT JOIN cells ON cells.run_id = a.run_id AND truth = a.label AND predicted = b.label"""))
def filled_confusion(lake: Lake) -> DataFrame:
    return routing.filled_confusion(routing.confusion_matrix(judged(lake)))


@query("D11_top_confusions", sql(*ROUTED, MATRIX_SQL, """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY n DESC, truth DESC, predicted DESC) AS INTEGER) AS rank
               FROM cells WHERE truth <> predicted) x WHERE rank <= 5"""))
def top_confusions(lake: Lake) -> DataFrame:
    return routing.top_confusions(routing.confusion_matrix(judged(lake)), 5)


@query("D12_routing_run_counts", sql(*ROUTED, """
SELECT run_id, count(*) AS attempted, count(*) FILTER (WHERE ok) AS evaluable,
       count(DISTINCT CASE WHEN ok THEN case_id END) AS n_cases,
       count(*) FILTER (WHERE ok) // count(DISTINCT CASE WHEN ok THEN case_id END) AS runs_per_case
FROM routed GROUP BY run_id"""))
def routing_run_counts(lake: Lake) -> DataFrame:
    return routing.run_counts(routed(lake))


@query("D13_no_evaluable_guard", sql(*ROUTED, WIDE_SQL, RUN_DIM_SQL, """
SELECT dim.run_id, exact_set_match, top1, critical_miss FROM dim LEFT JOIN wide ON dim.run_id = wide.run_id"""))
def no_evaluable_guard(lake: Lake) -> DataFrame:
    return routing.with_empty_runs(run_dim(lake), routing.scores(judged(lake))) \
        .select("run_id", "exact_set_match", "top1", "critical_miss")


# --- joins over runs and cases ------------------------------------------------


@query("C2_runs_with_case", sql(*ROUTED, """
SELECT run_id, type, severity, count(*) AS n, sum(len(expected))::BIGINT AS gold FROM routed GROUP BY 1, 2, 3"""))
def runs_with_case(lake: Lake) -> DataFrame:
    return routed(lake).groupBy("run_id", "type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("expected")).alias("gold"))


@query("C2_runs_by_dataset", sql(*ROUTED, """
SELECT run_id, type, count(*) AS n, sum(CASE WHEN run_id = 'R' THEN 0 ELSE len(expected) END)::BIGINT AS gold FROM routed GROUP BY 1, 2"""))
def runs_by_dataset(lake: Lake) -> DataFrame:
    """Two datasets share all case ids; in the one of run R no case expects a skill."""
    def named(column: Column) -> Column:
        return F.when(column, "older").otherwise("newer")

    cases = b.cases(lake)
    older = cases.withColumn("expected", F.array().cast("array<string>"))
    both = cases.withColumn("dataset_hash", named(F.lit(False))).unionByName(
        older.withColumn("dataset_hash", named(F.lit(True))))
    runs = b.runs(lake).withColumn("dataset_hash", named(F.col("run_id") == "R"))
    return report.routing_rows(runs, both).groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("expected")).alias("gold"))


@query("C2_orphan_cases", sql(b.CASES_SQL, b.RUNS_SQL, """
SELECT case_id, severity FROM cases WHERE case_id NOT IN (SELECT case_id FROM runs)"""))
def orphan_cases(lake: Lake) -> DataFrame:
    """The orphan report from the other side: cases no run ever executed."""
    return joins.orphan_runs(b.cases(lake), b.runs(lake), ["case_id"]).select("case_id", "severity")


@query("C5_evaluable_routing_runs", sql(b.RUNS_SQL, """
SELECT run_id, status, count(*) AS n FROM runs WHERE ok GROUP BY 1, 2"""))
def evaluable_routing_runs(lake: Lake) -> DataFrame:
    return joins.evaluable_routing_runs(b.runs(lake)).groupBy("run_id", "status") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("C11_unreachable_gold", sql(b.CASES_SQL, """
SELECT DISTINCT case_id, skill_id FROM (SELECT case_id, unnest(expected) AS skill_id FROM cases) x
WHERE skill_id NOT IN (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_discount > 0.05)"""))
def unreachable_gold(lake: Lake) -> DataFrame:
    gold = b.cases(lake).select("case_id", F.explode("expected").alias("skill_id"))
    shown = lake.lineitem.filter("l_discount > 0.05").select(F.col("l_returnflag").alias("skill_id"))
    return joins.unreachable_gold(gold, shown.distinct(), [])


MODELS = ["model-a", "model b", "model/c"]


@query("C1_build_matrix", sql(b.CASES_SQL, """
SELECT 'nightly' AS suite_id, '2024+02' AS execution_id, m.model_id, case_id, CAST(r.r AS INTEGER) AS repeat_index,
       CAST(t.t AS INTEGER) AS turn_index,
       'nightly.' || m.slug || '.' || case_id || '.t' || t.t || '.r' || r.r AS request_id,
       'eval.2024+02.nightly.' || m.slug || '.' || case_id || '.r' || r.r AS session_id,
       m.model_order
FROM cases, (VALUES ('model-a', 'model-a', 0), ('model b', 'model-b', 1), ('model/c', 'model-c', 2)) m(model_id, slug, model_order),
     range(3) r(r), range(1, 4) t(t)
WHERE t.t <= CASE kind WHEN 'multi' THEN 3 ELSE 1 END"""))
def build_matrix(lake: Lake) -> DataFrame:
    cases = b.cases(lake).select("case_id")
    turns = F.when(text.case_type(F.col("case_id")) == "multi", 3).otherwise(1)
    return joins.build_matrix(cases, MODELS, 3, "nightly", "2024+02", turn_count=turns)


@query("N4_work_estimate", sql(b.CASES_SQL, """
SELECT dataset AS set_id, count(*) AS cases, sum(CASE kind WHEN 'multi' THEN 3 ELSE 1 END)::BIGINT AS turns,
       (sum(CASE kind WHEN 'multi' THEN 3 ELSE 1 END) * 3)::BIGINT AS tasks_per_model,
       (sum(CASE kind WHEN 'multi' THEN 3 ELSE 1 END) * 9)::BIGINT AS planned_requests
FROM cases GROUP BY 1"""))
def work_estimate(lake: Lake) -> DataFrame:
    turns = F.when(text.case_type(F.col("case_id")) == "multi", 3).otherwise(1)
    cases = b.cases(lake).select(F.col("dataset").alias("set_id"), turns.alias("turn_count"))
    return inspection.work_estimate(cases, MODELS, 3)


# --- reliability and cost -----------------------------------------------------


@query("F1_stats", sql(b.RUNS_SQL, """
SELECT run_id, round(avg(duration_ms), 6) AS mean, round(coalesce(stddev_samp(duration_ms), 0), 6) AS stddev,
       min(duration_ms)::DOUBLE AS min, max(duration_ms)::DOUBLE AS max FROM runs GROUP BY run_id"""))
def basic_stats(lake: Lake) -> DataFrame:
    return rounded(stats.stats(b.runs(lake), ["run_id"], "duration_ms"))


def rounded(df: DataFrame, columns: tuple[str, ...] = ("mean", "stddev")) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("F2_stability", sql(*ROUTED, """,
per AS (SELECT run_id, repeat_index, avg(exact::INT) AS rate FROM jd GROUP BY 1, 2)
SELECT run_id, round(avg(rate), 6) AS mean, round(CASE WHEN count(rate) = 1 THEN 0 ELSE stddev_samp(rate) END, 6) AS stddev,
       min(rate) AS min, max(rate) AS max FROM per GROUP BY run_id"""))
def stability(lake: Lake) -> DataFrame:
    return rounded(stats.stability(judged(lake), "exact"))


LAST_SQL = """
lst AS (SELECT run_id, case_id, repeat_index, arg_max(exact, line_no) AS exact FROM jd GROUP BY 1, 2, 3),
grp AS (SELECT run_id, case_id, count(*) AS repeats, bool_or(exact) AS any_ok, bool_and(exact) AS all_ok FROM lst GROUP BY 1, 2)"""


@query("F3_pass_at_k", sql(*ROUTED, LAST_SQL, """
SELECT run_id, count(*) FILTER (WHERE repeats = 2) AS complete_cases,
       avg(CASE WHEN repeats = 2 THEN any_ok::INT END) AS pass_at_k FROM grp GROUP BY run_id"""))
def pass_at_k(lake: Lake) -> DataFrame:
    return stats.pass_rates(judged(lake), "exact", 2).drop("pass_all_k")


@query("F4_pass_all_k", sql(*ROUTED, LAST_SQL, """
SELECT run_id, avg(CASE WHEN repeats = 3 THEN all_ok::INT END) AS pass_all_k FROM grp GROUP BY run_id"""))
def pass_all_k(lake: Lake) -> DataFrame:
    return stats.pass_rates(judged(lake), "exact", 3).select("run_id", "pass_all_k")


EFFICIENCY_SQL = """
eff AS (SELECT run_id, duration_ms / 1000e0 AS time_seconds,
   coalesce(total_tokens, CASE WHEN input_tokens IS NOT NULL OR output_tokens IS NOT NULL
            THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END) AS tokens,
   CASE WHEN tax = 5 THEN 3e0 WHEN tax = 4 THEN NULL WHEN tax = 3 THEN 0e0
        ELSE 1e0 + CASE WHEN l_linenumber % 3 = 2 THEN l_linenumber ELSE 1 END END AS tool_calls,
   CASE WHEN error_kind IS NOT NULL THEN 1e0 ELSE 0e0 END AS errors FROM runs)"""


@query("F5_efficiency", sql(b.RUNS_SQL, EFFICIENCY_SQL, """,
long AS (UNPIVOT eff ON time_seconds, tokens, tool_calls, errors INTO NAME metric VALUE v)
SELECT run_id, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, min(v) AS min, max(v) AS max,
       count(v) AS n FROM long GROUP BY 1, 2"""))
def efficiency(lake: Lake) -> DataFrame:
    return rounded(stats.efficiency(b.runs(lake)))


@query("B5_tokens", sql(b.RUNS_SQL, EFFICIENCY_SQL, """
SELECT run_id, count(tokens) AS known, sum(tokens) AS tokens, count(*) AS n FROM eff GROUP BY run_id"""))
def tokens(lake: Lake) -> DataFrame:
    value = usage.tokens(F.col("usage"))
    return b.runs(lake).groupBy("run_id").agg(
        F.count(value).alias("known"), F.sum(value).alias("tokens"), F.count(F.lit(1)).alias("n"))


@query("B6_tool_call_count", sql(b.RUNS_SQL, EFFICIENCY_SQL, """
SELECT run_id, tool_calls, count(*) AS n FROM eff GROUP BY run_id, tool_calls"""))
def tool_call_count(lake: Lake) -> DataFrame:
    return b.runs(lake).groupBy(
        "run_id", usage.tool_call_count(F.col("usage"), F.col("tool_calls")).alias("tool_calls")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("F6_flaky_cases", sql(*ROUTED, """
SELECT run_id, case_id, count(*) FILTER (WHERE exact) AS passed, count(*) AS runs,
       count(*) FILTER (WHERE exact) / count(*) AS pass_rate
FROM jd GROUP BY 1, 2 HAVING count(*) FILTER (WHERE exact) > 0 AND count(*) FILTER (WHERE exact) < count(*)"""))
def flaky_cases(lake: Lake) -> DataFrame:
    return stats.flaky_cases(judged(lake), "exact")


@query("F7_non_discriminating", sql(*ROUTED, """,
rates AS (SELECT run_id, case_id, avg(exact::INT) AS rate FROM jd GROUP BY 1, 2)
SELECT 'run-F' AS baseline, 'run-O' AS treatment, x.case_id FROM rates x JOIN rates y ON x.case_id = y.case_id
WHERE x.run_id = 'run-F' AND y.run_id = 'run-O' AND x.rate >= 1 AND y.rate >= 1"""))
def non_discriminating(lake: Lake) -> DataFrame:
    rates = judged(lake).groupBy("run_id", "case_id").agg(F.avg(F.col("exact").cast("double")).alias("rate"))
    pairs = b.runs(lake).groupBy(F.substring("run_id", 1, 3).alias("set_id")).agg(
        F.min("run_id").alias("baseline"), F.max("run_id").alias("treatment"))
    return stats.non_discriminating(rates, pairs).select("baseline", "treatment", "case_id")


@query("F8_F10_reliability", sql(*ROUTED, """,
per AS (SELECT run_id, repeat_index, avg(exact::INT) AS rate FROM jd GROUP BY 1, 2),
pc AS (SELECT run_id, case_id, count(*) FILTER (WHERE exact) AS p, count(*) AS n FROM jd GROUP BY 1, 2),
fl AS (SELECT run_id, avg((p > 0 AND p < n)::INT) AS flaky_rate FROM pc GROUP BY 1)
SELECT per.run_id, round(avg(rate), 6) AS repeat_pass_rate, round(stddev_samp(rate), 6) AS variance, any_value(flaky_rate) AS flaky_rate
FROM per JOIN fl USING (run_id) GROUP BY per.run_id"""))
def reliability(lake: Lake) -> DataFrame:
    rows = judged(lake).withColumn("done", F.col("exact")).withColumn("skipped", F.lit(False))
    return rounded(stats.reliability(rows), ("repeat_pass_rate", "variance"))


@query("F11_run_usage", sql(b.RUNS_SQL, EFFICIENCY_SQL, """
SELECT run_id, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(CAST(time_seconds * 1000 AS BIGINT)) / 1000, 6) AS total_seconds,
       count(*) AS runs, count(*) FILTER (WHERE tokens IS NULL) AS runs_missing_tokens,
       count(*) FILTER (WHERE time_seconds IS NULL) AS runs_missing_duration FROM eff GROUP BY run_id"""))
def run_usage(lake: Lake) -> DataFrame:
    return rounded(stats.run_usage(b.runs(lake)), ("total_seconds",))


def lineage(lake: Lake) -> DataFrame:
    """Each customer's orders as the iterations of one improvement lineage."""
    price = F.floor("o_totalprice").cast("bigint")
    return lake.orders.select(
        F.col("o_custkey").alias("lineage_id"), F.col("o_orderkey").alias("iteration"),
        F.concat(F.lit("run-"), "o_orderkey").alias("run_id"), price.alias("total_tokens"),
        (price % 1000).alias("total_seconds"), F.lit(1).cast("bigint").alias("runs"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).cast("bigint").alias("runs_missing_tokens"),
        F.lit(0).cast("bigint").alias("runs_missing_duration"),
        F.when(F.col("o_custkey") > 100, 1500000).cast("bigint").alias("max_total_tokens"),
        F.lit(4000).cast("bigint").alias("max_total_seconds"),
        F.col("o_orderdate").alias("at"), (F.col("o_orderpriority") == "1-URGENT").alias("gate_pass"))


LINEAGE_SQL = """
lin AS (SELECT o_custkey AS lineage_id, o_orderkey AS iteration, CAST(floor(o_totalprice) AS BIGINT) AS tok,
               CAST(floor(o_totalprice) AS BIGINT) % 1000 AS sec, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS miss,
               CASE WHEN o_custkey > 100 THEN 1500000 END AS cap, o_orderpriority, o_orderkey FROM orders),
cum AS (SELECT *, sum(tok) OVER w AS ct, sum(sec) OVER w AS cs, sum(miss) OVER w AS cm, row_number() OVER w AS pos FROM lin
        WINDOW w AS (PARTITION BY lineage_id ORDER BY iteration))"""


@query("F12_cumulative_usage", sql(LINEAGE_SQL, """
SELECT lineage_id, iteration, ct::BIGINT AS cum_total_tokens, cs::BIGINT AS cum_total_seconds, cm::BIGINT AS cum_runs_missing_tokens,
       NOT (cap IS NOT NULL AND cm > 0) AS usable FROM cum"""))
def cumulative_usage(lake: Lake) -> DataFrame:
    return stats.cumulative_usage(lineage(lake)).select(
        "lineage_id", "iteration", "cum_total_tokens", "cum_total_seconds", "cum_runs_missing_tokens", "usable")


@query("F12_duplicate_lineage_runs", """
SELECT l_suppkey AS lineage_id, 'run-' || l_orderkey AS run_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_lineage_runs(lake: Lake) -> DataFrame:
    rows = lake.lineitem.select(
        F.col("l_suppkey").alias("lineage_id"), F.concat(F.lit("run-"), "l_orderkey").alias("run_id"))
    return stats.duplicate_lineage_runs(rows)


@query("F13_stop_decision", sql(LINEAGE_SQL, """
SELECT lineage_id, iteration,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'gate_pass' WHEN coalesce(ct >= cap, false) OR cs >= 4000 THEN 'budget_exceeded'
            WHEN pos >= 8 THEN 'max_iterations' END AS stop_reason,
       concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' THEN 'gate_pass' END,
                 CASE WHEN coalesce(ct >= cap, false) OR cs >= 4000 THEN 'budget_exceeded' END,
                 CASE WHEN pos >= 8 THEN 'max_iterations' END) AS triggered FROM cum"""))
def stop_decision(lake: Lake) -> DataFrame:
    rows = ordered.positions(stats.cumulative_usage(lineage(lake)), ["lineage_id"], "iteration", "round")
    decided = stats.stop_decision(
        rows.withColumn("order_key", F.col("iteration")).withColumn("iteration", F.col("round"))
        .withColumn("max_iterations", F.lit(8)))
    return decided.select("lineage_id", F.col("order_key").alias("iteration"), "stop_reason",
                          F.array_join("triggered", ",").alias("triggered"))


@query("F14_iteration_policy", """
SELECT lineage_id, iteration, iteration <> prev + 1 AS iteration_jump, cap <> pcap AS limits_changed FROM (
  SELECT *, lag(iteration) OVER w AS prev, lag(cap) OVER w AS pcap FROM (
    SELECT o_custkey AS lineage_id, o_orderkey AS iteration, CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 3 END AS cap FROM orders) o
  WINDOW w AS (PARTITION BY lineage_id ORDER BY iteration)) x
WHERE prev IS NOT NULL AND (iteration <> prev + 1 OR cap <> pcap)""")
def iteration_policy(lake: Lake) -> DataFrame:
    rows = lineage(lake).withColumn("max_total_tokens", F.lit(None).cast("bigint"))
    low = lake.orders.select(
        F.col("o_orderkey").alias("iteration"),
        F.when(F.col("o_orderpriority") == "5-LOW", 2).otherwise(3).alias("max_iterations"))
    return stats.iteration_policy(rows.join(low, "iteration"))


# --- gates and verdicts -------------------------------------------------------

LONG_SQL = """
long AS (UNPIVOT (SELECT run_id, exact_set_match, critical_miss, type_rej FROM wide)
         ON exact_set_match, critical_miss, type_rej INTO NAME metric VALUE actual)"""
CHECKED_SQL = """
chk AS (SELECT dim.run_id, gate.metric, gate.condition, long.actual,
               CASE WHEN gate.op = '>=' THEN long.actual >= gate.threshold ELSE long.actual <= gate.threshold END AS pass
        FROM dim CROSS JOIN gate LEFT JOIN long ON long.run_id = dim.run_id AND long.metric = gate.metric)"""


@b.shared
def long_scores(lake: Lake) -> DataFrame:
    return routing.long_scores(routing.scores(judged(lake)), routing.METRICS)


@query("J1_check_gate", sql(*ROUTED, WIDE_SQL, RUN_DIM_SQL, LONG_SQL, CHECKED_SQL, "SELECT * FROM chk"))
def check_gate(lake: Lake) -> DataFrame:
    checked = gates.check_gate(gates.explode_gate(run_dim(lake)), long_scores(lake))
    return checked.select("run_id", "metric", "condition", "actual", "pass")


VERDICT_SQL = """
cnt AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE error_kind IN ('runtime', 'network', 'harness')) AS s FROM runs GROUP BY 1),
oc AS (SELECT run_id, CASE WHEN bool_or(NOT pass) THEN false WHEN bool_or(pass) THEN true END AS observed FROM chk GROUP BY 1),
vd AS (SELECT dim.run_id, coalesce(n, 0) AS n_runs, coalesce(s, 0) AS n_system_failures,
   CASE WHEN coalesce(n, 0) = 0 OR s >= n OR observed IS NULL THEN 'indeterminate' WHEN observed THEN 'pass' ELSE 'fail' END AS quality_verdict
   FROM dim LEFT JOIN cnt USING (run_id) LEFT JOIN oc USING (run_id))"""


@b.shared
def verdicts(lake: Lake) -> DataFrame:
    return report.verdicts(run_dim(lake), b.runs(lake), long_scores(lake))


@query("J3_derive_verdict", sql(*ROUTED, WIDE_SQL, RUN_DIM_SQL, LONG_SQL, CHECKED_SQL, VERDICT_SQL, """
SELECT run_id, n_runs, n_system_failures, quality_verdict, upper(quality_verdict) AS label,
       CASE quality_verdict WHEN 'pass' THEN true WHEN 'fail' THEN false END AS gate_pass FROM vd"""))
def derive_verdict(lake: Lake) -> DataFrame:
    zero = F.lit(0)
    return verdicts(lake).select(
        "run_id", F.coalesce("n_runs", zero).alias("n_runs"),
        F.coalesce("n_system_failures", zero).alias("n_system_failures"), "quality_verdict", "label", "gate_pass")


@query("J2_calibrated_outcome", sql(*ROUTED, WIDE_SQL, RUN_DIM_SQL, LONG_SQL, CHECKED_SQL, """
SELECT run_id, CASE WHEN bool_or(NOT pass AND metric <> 'type_rej') THEN false ELSE NULL END AS observed_passed FROM chk GROUP BY run_id"""))
def calibrated_outcome(lake: Lake) -> DataFrame:
    checked = gates.check_gate(gates.explode_gate(run_dim(lake)), long_scores(lake))
    return gates.calibrated_outcome(checked.withColumn("unqualified", F.col("metric") == "type_rej"))


@query("J4_system_failure_counts", sql(b.RUNS_SQL, """
SELECT run_id, count(*) AS n_runs, count(*) FILTER (WHERE error_kind IN ('runtime', 'network', 'harness')) AS n_system_failures,
       count(*) FILTER (WHERE error_kind = 'runtime') AS runtime_failures, count(*) FILTER (WHERE error_kind = 'network') AS network_failures,
       count(*) FILTER (WHERE error_kind = 'harness') AS harness_failures FROM runs GROUP BY run_id"""))
def system_failure_counts(lake: Lake) -> DataFrame:
    return gates.system_failure_counts(b.runs(lake))


SUBKIND_SQL = """
sub AS (SELECT *, CASE WHEN error_kind = 'network' THEN CASE error WHEN 'Insufficient balance' THEN 'provider_quota_exhausted'
   WHEN 'HTTP 401 Unauthorized' THEN 'provider_authentication' WHEN 'getaddrinfo failed' THEN 'network_dns'
   WHEN 'read timed out' THEN 'network_timeout' WHEN 'Rate limit reached' THEN 'provider_rate_limited'
   ELSE 'network_connectivity' END END AS subkind FROM runs)"""


@query("J5_failure_summary", sql(b.RUNS_SQL, SUBKIND_SQL, """
SELECT run_id, 'kind' AS level, coalesce(error_kind, 'unclassified') AS category, count(*) AS n, false AS advised
FROM sub WHERE NOT ok GROUP BY 1, 2, 3
UNION ALL SELECT run_id, 'subkind', subkind, count(*), true FROM sub WHERE NOT ok AND subkind IS NOT NULL GROUP BY 1, 2, 3"""))
def failure_summary(lake: Lake) -> DataFrame:
    filled = b.runs(lake).withColumn(
        "error_subkind", text.error_subkind(F.col("error_kind"), F.col("error")))
    return gates.failure_summary(filled).drop("action")


@query("B9_error_subkind", sql(b.RUNS_SQL, SUBKIND_SQL, """
SELECT error_kind, subkind AS error_subkind, count(*) AS n FROM sub GROUP BY 1, 2"""))
def error_subkind(lake: Lake) -> DataFrame:
    sub = text.error_subkind(F.col("error_kind"), F.col("error")).alias("error_subkind")
    return b.runs(lake).groupBy("error_kind", sub).agg(F.count(F.lit(1)).alias("n"))


@query("B10_error_kind_from_text", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'econnrefused|enotfound|etimedout|socket hang up|network|fetch failed|rate limit|429|502|503|504|timeout')
                    THEN 'network' ELSE 'runtime' END AS error_kind FROM documents""")
def error_kind_from_text(lake: Lake) -> DataFrame:
    return lake.documents.select("doc_id", text.error_kind_from_text(F.col("text")).alias("error_kind"))


@query("J6_gate_coverage", sql(b.CASES_SQL, """
SELECT run_id, metric FROM (
  SELECT run_id, unnest(['critical_miss', 'multi_exact', 'top1']) AS metric,
         unnest([count(*) FILTER (WHERE severity = 'critical'), count(*) FILTER (WHERE len(expected) > 1),
                 count(*) FILTER (WHERE len(expected) = 1)]) AS eligible
  FROM (SELECT dataset || '-' || severity || '-' || kind AS run_id, * FROM cases) c GROUP BY run_id) x WHERE eligible = 0"""))
def gate_coverage(lake: Lake) -> DataFrame:
    kind = text.case_type(F.col("case_id"))
    cases = b.cases(lake).select(
        F.concat_ws("-", "dataset", "severity", kind).alias("run_id"), "expected", "severity", kind.alias("type"))
    gated = cases.select("run_id").distinct().select("run_id", F.explode(F.array(
        F.lit("critical_miss"), F.lit("multi_exact"), F.lit("top1"), F.lit("task_completion"))).alias("metric"))
    return gates.gate_coverage(gated, cases)


@query("B26_parse_gate", """
SELECT page_id, ok, CASE WHEN ok THEN op END AS op, CASE WHEN ok THEN CAST(num AS DOUBLE) END AS threshold FROM (
  SELECT page_id, CASE WHEN n % 2 = 0 THEN '>=' ELSE '<=' END AS op, CASE WHEN n >= 1500 THEN '1.00' WHEN n % 100 < 10 THEN '0.0' || (n % 100) ELSE '0.' || (n % 100) END AS num, n < 1500 OR n % 100 = 0 AS ok
  FROM (SELECT page_id, length(html) AS n FROM pages) p) x""")
def parse_gate(lake: Lake) -> DataFrame:
    n = F.length("html")
    number = F.concat(F.when(n < 1500, "0.").otherwise("1."), F.lpad((n % 100).cast("string"), 2, "0"))
    condition = F.concat_ws(" ", F.when(n % 2 == 0, ">=").otherwise("<="), number)
    parsed = case_functions.gate_condition(condition)
    return lake.pages.select("page_id", parsed.alias("g")).select(
        "page_id", (F.col("g.op").isNotNull()).alias("ok"), "g.op", "g.threshold")


# --- evaluator layers ---------------------------------------------------------


@plugins.register_evaluator("share-of-expensive", version="1")
def share_of_expensive(tables: plugins.Tables) -> DataFrame:
    return tables.scores.select("run_id", "metric", "value")


@plugins.register_evaluator("first-only", version="1")
def first_only(tables: plugins.Tables) -> DataFrame:
    changed = F.when(F.col("run_id") == "1-URGENT", F.col("value") + 1).otherwise(F.col("value"))
    return tables.scores.filter("metric = 'm_F'").select("run_id", "metric", changed.alias("value"))


@plugins.register_evaluator("shown-only", version="1", exposed=False)
def shown_only(tables: plugins.Tables) -> DataFrame:
    return tables.scores.select("run_id", F.lit("hidden").alias("metric"), "value")


@query("O1_J7_merge_scalar_metrics", sql(b.SCORES_SQL, """
SELECT run_id, metric, value, metric = 'm_F' AND run_id = '1-URGENT' AS conflict FROM scores"""))
def merge_scalar_metrics(lake: Lake) -> DataFrame:
    tables = plugins.Tables(runs=b.runs(lake), scores=b.scores(lake))
    return plugins.gate_metrics(["shown-only", "first-only", "share-of-expensive"], tables)


@query("J8_layer_report", sql(b.SCORES_SQL, """
SELECT run_id, 'outcome' AS evaluator, metric, value, true AS exposed FROM scores
UNION ALL SELECT run_id, 'trajectory', metric || '_t', value, true FROM scores
UNION ALL SELECT run_id, 'reliability', metric || '_r', value, false FROM scores
UNION ALL SELECT run_id, 'efficiency', metric || '_e', value, false FROM scores"""))
def layer_report(lake: Lake) -> DataFrame:
    def part(suffix: str) -> DataFrame:
        return b.scores(lake).withColumn("metric", F.concat("metric", F.lit(suffix)))

    return gates.layer_report(part(""), part("_t"), part("_r"), part("_e"))


@query("F15_semantic_mean", sql(b.JUDGED_SQL, """
SELECT source AS run_id, round(avg(m), 6) AS final_answer_quality FROM (
  SELECT source, dimension, avg(judge_score) AS m FROM judged GROUP BY 1, 2) x GROUP BY 1"""))
def semantic_mean(lake: Lake) -> DataFrame:
    means = b.judged(lake).groupBy(F.col("source").alias("run_id"), F.col("dimension").alias("metric")) \
        .agg(F.avg("judge_score").alias("value"))
    return rounded(stats.semantic_mean(means, list(RUBRICS)), ("final_answer_quality",))


# --- comparison ---------------------------------------------------------------


def members(runs: DataFrame, set_id: Column) -> DataFrame:
    """Runs with their comparison set; the smallest run id of a set is its baseline."""
    named = runs.select("run_id").distinct().withColumn("set_id", set_id)
    first = named.groupBy("set_id").agg(F.min("run_id").alias("baseline"))
    return named.join(first, "set_id")


@query("K2_metric_delta", sql(b.SCORES_SQL, """
SELECT r.set_id, r.run_id, m.metric, s.value, base.value AS base_value, s.value - base.value AS delta
FROM (SELECT DISTINCT o_orderpriority AS run_id, CASE WHEN o_orderpriority < '3' THEN 'urgent' ELSE 'normal' END AS set_id FROM orders) r
CROSS JOIN (SELECT DISTINCT metric FROM scores) m
LEFT JOIN scores s ON s.run_id = r.run_id AND s.metric = m.metric
LEFT JOIN scores base ON base.run_id = CASE r.set_id WHEN 'urgent' THEN '1-URGENT' ELSE '3-MEDIUM' END AND base.metric = m.metric"""))
def metric_delta(lake: Lake) -> DataFrame:
    sets = members(b.scores(lake), F.when(F.col("run_id") < "3", "urgent").otherwise("normal"))
    return compare.metric_delta(b.scores(lake), sets)


@query("K4_efficiency_delta", sql(b.RUNS_SQL, EFFICIENCY_SQL, """,
long AS (UNPIVOT eff ON time_seconds, tokens, tool_calls, errors INTO NAME metric VALUE v),
m AS (SELECT run_id, metric, avg(v) AS value FROM long GROUP BY 1, 2)
SELECT 'run' AS set_id, a.run_id, a.metric, round(a.value, 6) AS value, round(z.value, 6) AS base_value, round(a.value - z.value, 6) AS delta
FROM m a JOIN m z ON a.metric = z.metric AND z.run_id = 'run-F'"""))
def efficiency_delta(lake: Lake) -> DataFrame:
    sets = members(b.runs(lake), F.substring("run_id", 1, 3))
    return rounded(compare.efficiency_delta(stats.efficiency(b.runs(lake)), sets),
                   ("value", "base_value", "delta"))


def configs(lake: Lake) -> DataFrame:
    return lake.supplier.join(lake.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("set"), "n_regionkey").alias("set_id"), F.col("s_name").alias("run_id"),
        F.concat(F.lit("cfg"), "n_regionkey").alias("skillcfg"), F.col("n_name").alias("model"),
        F.when(F.col("s_acctbal") > 0, 3).alias("repeats"),
        F.when(F.col("s_acctbal") > 9000, "j1").alias("judge"))


CONFIG_SQL = """
cfg AS (SELECT 'set' || n_regionkey AS set_id, s_name AS run_id, n_name AS model, CASE WHEN s_acctbal > 9000 THEN 'j1' END AS judge
        FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("K1_config_diff", sql(CONFIG_SQL, """
SELECT set_id, 'model' AS field, 'pollution' AS class, min(model) AS low, max(model) AS high FROM cfg GROUP BY 1 HAVING min(model) <> max(model)
UNION ALL
SELECT set_id, 'judge', 'gauge', min(judge), max(judge) FROM cfg GROUP BY 1 HAVING count(judge) > 0 AND count(judge) < count(*)"""))
def config_diff(lake: Lake) -> DataFrame:
    return compare.config_diff(configs(lake))


@query("K3_judged_rows_flag", sql(CONFIG_SQL, """,
g AS (SELECT set_id FROM cfg GROUP BY 1 HAVING count(judge) > 0 AND count(judge) < count(*))
SELECT set_id, run_id, metric, NOT (metric = 'faithfulness' AND set_id IN (SELECT set_id FROM g)) AS comparable
FROM cfg, (VALUES ('faithfulness'), ('top1')) m(metric)"""))
def judged_rows_flag(lake: Lake) -> DataFrame:
    rows = configs(lake).select("set_id", "run_id", F.explode(F.array(
        F.lit("faithfulness"), F.lit("top1"))).alias("metric"))
    return compare.judged_rows_flag(rows, compare.config_diff(configs(lake)))


@query("K5_same_execution_facts", """
SELECT o_custkey AS set_id, count(*) FILTER (WHERE o_orderstatus <> 'P') = count(*) AND coalesce(min(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END)
       = max(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END), false) AS same_facts FROM orders GROUP BY 1""")
def same_execution_facts(lake: Lake) -> DataFrame:
    rows = lake.orders.select(
        F.col("o_custkey").alias("set_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("source_runs_sha256"))
    return compare.same_execution_facts(rows)


@query("K6_run_summary", sql(*ROUTED, WIDE_SQL, RUN_DIM_SQL, LONG_SQL, CHECKED_SQL, VERDICT_SQL, """
SELECT vd.run_id, n_runs, quality_verdict, exact_set_match, critical_miss FROM vd LEFT JOIN wide ON vd.run_id = wide.run_id"""))
def run_summary(lake: Lake) -> DataFrame:
    live = verdicts(lake).select("run_id", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "quality_verdict")
    return compare.run_summary(run_dim(lake).select("run_id"), live, long_scores(lake),
                               ["exact_set_match", "critical_miss"])


@query("K7_rescore_provenance", """
SELECT s_name, 'sha256:' || substr(sha256('{"source":{"name":"' || s_name || '"},"gauge":{"nation":' || s_nationkey || ',"judge":null}}'), 1, 16) AS grading_hash
FROM supplier""")
def rescore_provenance(lake: Lake) -> DataFrame:
    return lake.supplier.select("s_name", compare.grading_hash(
        [F.col("s_name").alias("name")],
        [F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("judge")]).alias("grading_hash"))


# --- evidence and inspection --------------------------------------------------


@query("L1_routing_failures", sql(*ROUTED, """
SELECT run_id, case_id, repeat_index, array_to_string(expected, '|') AS expected, array_to_string(selected, '|') AS selected
FROM routed WHERE coalesce(error_kind, '') NOT IN ('runtime', 'network', 'harness') AND (NOT ok OR expected <> selected)"""))
def routing_failures(lake: Lake) -> DataFrame:
    rows = routed(lake)
    for name in ("raw_output", "reasoning", "error"):
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    return evidence.routing_failures(rows).select(
        "run_id", "case_id", "repeat_index", F.array_join("expected", "|").alias("expected"),
        F.array_join("selected", "|").alias("selected"))


def records(lake: Lake) -> DataFrame:
    cases = b.cases(lake).select(
        "case_id", F.col("label").alias("prompt"), F.col("expected").alias("expected_skills"))
    return inspection.inspect_records(b.runs(lake).withColumn("selected_skills", F.col("selected")), cases)


MODEL_SQL = "CASE WHEN tax > 4 THEN 'hub/m' || (l_suppkey % 5) ELSE 'openai/M' || (l_suppkey % 3) END"


@query("N1_inspect_records", sql(b.RUNS_SQL, SUBKIND_SQL, f"""
SELECT run_id, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, {MODEL_SQL} AS model, subkind AS error_subkind, count(*) AS n
FROM sub GROUP BY 1, 2, 3, 4"""))
def inspect_records(lake: Lake) -> DataFrame:
    return records(lake).groupBy("run_id", "status", "model", "error_subkind").agg(F.count(F.lit(1)).alias("n"))


@query("N2_filter_records", sql(b.CASES_SQL, b.RUNS_SQL, f"""
SELECT r.run_id, r.case_id, r.repeat_index, {MODEL_SQL} AS model FROM runs r JOIN cases c USING (case_id)
WHERE r.ok AND repeat_index = 1 AND lower({MODEL_SQL}) LIKE '%hub%' AND ('A' = l_returnflag OR list_contains(c.expected, 'A') OR list_contains(selected, 'A'))"""))
def filter_records(lake: Lake) -> DataFrame:
    kept = inspection.filter_records(records(lake), turn=1, repeat=1, status="ok", skill="A", model="HUB")
    return kept.select("run_id", "case_id", "repeat_index", "model")


@query("N3_inspection_summary", sql(*ROUTED, WIDE_SQL, RUN_DIM_SQL, LONG_SQL, CHECKED_SQL, VERDICT_SQL, """
SELECT r.run_id, count(*) AS record_count, count(*) FILTER (WHERE ok) AS ok_count, count(*) FILTER (WHERE NOT ok) AS failed_count,
       0 AS skipped_count, any_value(quality_verdict) AS quality_verdict, 'pass' AS historical_quality_verdict
FROM runs r JOIN vd ON r.run_id = vd.run_id GROUP BY r.run_id"""))
def inspection_summary(lake: Lake) -> DataFrame:
    archived = run_dim(lake).select(
        "run_id", F.lit("pass").alias("historical_quality_verdict"), F.lit(True).alias("historical_gate_pass"))
    return inspection.inspection_summary(records(lake), verdicts(lake), archived).select(
        "run_id", "record_count", "ok_count", "failed_count", "skipped_count", "quality_verdict",
        "historical_quality_verdict")


@query("N3_observed_models", sql(b.RUNS_SQL, f"SELECT DISTINCT run_id, {MODEL_SQL} AS model FROM runs"))
def observed_models(lake: Lake) -> DataFrame:
    return inspection.observed_models(records(lake))


@query("routing_report", sql(*ROUTED, WIDE_SQL, LAST_SQL, """
SELECT run_id, metric, value FROM (UNPIVOT (SELECT wide.*, p.pass_at_k, p.pass_all_k FROM wide JOIN (
   SELECT run_id, avg(CASE WHEN repeats = 3 THEN any_ok::INT END) AS pass_at_k, avg(CASE WHEN repeats = 3 THEN all_ok::INT END) AS pass_all_k
   FROM grp GROUP BY 1) p ON wide.run_id = p.run_id)
  ON COLUMNS(* EXCLUDE run_id) INTO NAME metric VALUE value)"""))
def routing_report(lake: Lake) -> DataFrame:
    return report.routing_scores(routed(lake), 3)
