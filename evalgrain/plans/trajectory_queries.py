"""Queries on tool events: selection, arguments, order, state, read-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import arguments as args
from evalgrain.operators import trajectory
from evalgrain.plans import bindings as b
from evalgrain.plans.bindings import Lake
from evalgrain.plans.catalog import query, sql
from evalgrain.schemas import EVENT, TRAJECTORY_METRICS

K = b.EVENT_KEYS

EXPECT_SQL = """
exp AS (SELECT run_id, case_id, user_id,
  CASE user_id % 3 WHEN 0 THEN ['view', 'click'] WHEN 1 THEN ['purchase'] ELSE [] END AS required_tools,
  CASE WHEN user_id % 2 = 0 THEN ['error'] ELSE [] END AS forbidden_tools, user_id % 4 = 0 AS state, user_id % 2 = 1 AS verif FROM ek),
calls AS (SELECT *, value >= 1 AS known, CASE WHEN value > 120 THEN '<redacted>' WHEN value > 40 THEN 'fast' ELSE 'slow' END AS mode
          FROM ev WHERE event_type = 'tool_call' AND evidence_level = 'exact'),
arts AS (SELECT DISTINCT run_id, case_id, CAST(k AS VARCHAR) AS path FROM ev WHERE tool_name = 'signup')"""

BASE = (b.EVENTS_SQL, EXPECT_SQL)


@b.shared
def expectations(lake: Lake) -> DataFrame:
    user = F.col("user_id")
    return b.event_keys(b.events(lake)).select(
        *K, "user_id",
        F.when(user % 3 == 0, b.strings("view", "click")).when(user % 3 == 1, b.strings("purchase"))
        .otherwise(b.strings()).alias("required_tools"),
        F.when(user % 2 == 0, b.strings("error")).otherwise(b.strings()).alias("forbidden_tools"),
        F.when(user % 3 == 0, b.strings("view", "click", "view"))
        .when(user % 3 == 1, b.strings("purchase", "purchase")).otherwise(b.strings()).alias("required_order"),
        (user % 4 == 0).alias("required_state_change"), (user % 2 == 1).alias("required_verification"),
        b.strings("view").alias("verification_tools"))


@b.shared
def artifacts(lake: Lake) -> DataFrame:
    return b.events(lake).filter("tool_name = 'signup'") \
        .select(*K, F.col("k").cast("string").alias("path")).distinct()


def _json(text: str) -> Column:
    return F.parse_json(F.lit(text))


@b.shared
def assertions(lake: Lake) -> DataFrame:
    """Six assertions per run turn, one of each matcher and a second equals."""
    none, no_list = F.lit(None).cast("variant"), F.lit(None).cast("array<variant>")
    no_text = F.lit(None).cast("string")

    def rule(index, tool, path, matcher, equals=none, in_values=no_list, matches=no_text) -> Column:
        return F.struct(
            F.lit(index).alias("assertion_index"), F.lit(tool).alias("tool"), F.lit(path).alias("path"),
            F.lit(matcher).alias("matcher"), equals.alias("equals"), in_values.alias("in_values"),
            matches.alias("matches"))

    rules = F.array(
        rule(0, "view", "k", "required"),
        rule(1, "click", "opts.mode", "equals", equals=_json('"fast"')),
        rule(2, "purchase", "opts.list.1", "in", in_values=F.array(_json('"x"'), _json("3"))),
        rule(3, "view", "opts.list.0", "matches", matches=F.lit("^9")),
        rule(4, "purchase", "zzz", "forbidden"),
        rule(5, "click", "k", "equals", equals=_json("9.0")))
    return b.event_keys(b.events(lake)).select(*K, F.explode(rules).alias("_r")).select(*K, "_r.*")


@query("G1_observed_tools", sql(*BASE, """
SELECT DISTINCT run_id, case_id, tool_name AS tool FROM ev WHERE event_type IN ('tool_call', 'tool_result')"""))
def observed_tools(lake: Lake) -> DataFrame:
    return trajectory.observed_tools(b.events(lake), K).select("run_id", "case_id", "tool")


SELECTION_SQL = """
used AS (SELECT run_id, case_id, list(DISTINCT tool_name) AS tools FROM ev WHERE event_type IN ('tool_call', 'tool_result') GROUP BY 1, 2),
sel AS (SELECT exp.run_id, exp.case_id, (len(list_intersect(required_tools, coalesce(tools, []))) + len(forbidden_tools)
   - len(list_intersect(forbidden_tools, coalesce(tools, []))))::DOUBLE / nullif(len(required_tools) + len(forbidden_tools), 0) AS tool_selection
   FROM exp LEFT JOIN used ON exp.run_id = used.run_id AND exp.case_id = used.case_id)"""


@query("G2_tool_selection", sql(*BASE, SELECTION_SQL, "SELECT * FROM sel"))
def tool_selection(lake: Lake) -> DataFrame:
    observed = trajectory.observed_tools(b.events(lake), K)
    return trajectory.tool_selection(expectations(lake), observed, K).select("run_id", "case_id", "tool_selection")


ARGUMENTS_SQL = """
rules AS (SELECT * FROM (VALUES (0, 'view', 'required'), (1, 'click', 'equals'), (2, 'purchase', 'in'), (3, 'view', 'matches'),
  (4, 'purchase', 'forbidden'), (5, 'click', 'equals')) r(assertion_index, tool, matcher)),
anyx AS (SELECT run_id, case_id, count(*) AS exact_calls FROM calls GROUP BY 1, 2),
per AS (SELECT ek.run_id, ek.case_id, r.assertion_index, r.tool, r.matcher, count(c.step_index) AS relevant_calls,
   count(c.step_index) FILTER (WHERE NOT c.known) AS unknown, coalesce(bool_or(c.known AND r.assertion_index <> 4), false) AS present,
   coalesce(bool_or(r.assertion_index = 1 AND c.known AND c.mode = '<redacted>'), false) AS incomplete,
   coalesce(bool_or(c.known AND CASE r.assertion_index WHEN 1 THEN c.mode = 'fast' WHEN 2 THEN true
       WHEN 3 THEN CAST(c.k AS VARCHAR) LIKE '9%' WHEN 5 THEN c.k = 9 ELSE false END), false) AS met
   FROM ek CROSS JOIN rules r LEFT JOIN calls c ON c.run_id = ek.run_id AND c.case_id = ek.case_id AND c.tool_name = r.tool GROUP BY 1, 2, 3, 4, 5),
scored AS (SELECT per.run_id, per.case_id, assertion_index, tool, matcher, relevant_calls,
   CASE WHEN exact_calls IS NULL THEN NULL WHEN relevant_calls = 0 THEN 0e0
        WHEN matcher = 'required' THEN CASE WHEN present THEN 1e0 WHEN unknown > 0 THEN NULL ELSE 0e0 END
        WHEN matcher = 'forbidden' THEN CASE WHEN present THEN 0e0 WHEN unknown > 0 THEN NULL ELSE 1e0 END
        WHEN met THEN 1e0 WHEN unknown > 0 OR incomplete THEN NULL ELSE 0e0 END AS score
   FROM per LEFT JOIN anyx ON anyx.run_id = per.run_id AND anyx.case_id = per.case_id)"""


@b.shared
def scored(lake: Lake) -> DataFrame:
    return trajectory.argument_scores(b.events(lake), assertions(lake), K)


@query("G3_G7_argument_assertions", sql(*BASE, ARGUMENTS_SQL, """
SELECT *, CASE score WHEN 1 THEN 'passed' WHEN 0 THEN 'failed' ELSE 'insufficient_evidence' END AS status FROM scored"""))
def argument_assertions(lake: Lake) -> DataFrame:
    return scored(lake).drop("repeat_index", "turn_index")


def _one_matcher(number: int, matcher: str):
    @query(f"G{number}_argument_{matcher}", sql(*BASE, ARGUMENTS_SQL, f"""
SELECT run_id, case_id, assertion_index, score FROM scored WHERE matcher = '{matcher}'"""))
    def run(lake: Lake) -> DataFrame:
        rules = assertions(lake).filter(F.col("matcher") == matcher)
        return trajectory.argument_scores(b.events(lake), rules, K) \
            .select("run_id", "case_id", "assertion_index", "score")

    return run


for _number, _matcher in ((3, "required"), (4, "forbidden"), (5, "equals"), (6, "in"), (7, "matches")):
    _one_matcher(_number, _matcher)


@query("G8_argument_correctness", sql(*BASE, ARGUMENTS_SQL, """
SELECT run_id, case_id, avg(score) AS argument_correctness FROM scored GROUP BY 1, 2"""))
def argument_correctness(lake: Lake) -> DataFrame:
    return trajectory.argument_correctness(scored(lake), K).select("run_id", "case_id", "argument_correctness")


@query("G8_argument_evidence", sql(*BASE, ARGUMENTS_SQL, """
SELECT s.run_id, s.case_id, s.assertion_index, c.step_index, c.call_id FROM scored s
JOIN calls c ON c.run_id = s.run_id AND c.case_id = s.case_id AND (s.relevant_calls = 0 OR c.tool_name = s.tool)"""))
def argument_evidence(lake: Lake) -> DataFrame:
    return trajectory.argument_evidence(b.events(lake), scored(lake), K) \
        .select("run_id", "case_id", "assertion_index", "step_index", "call_id")


ORDER_SQL = """
w AS (SELECT run_id, case_id, user_id % 3 AS m, step_index, tool_name FROM calls WHERE user_id % 3 < 2),
s1 AS (SELECT run_id, case_id, m, min(CASE WHEN tool_name = CASE m WHEN 0 THEN 'view' ELSE 'purchase' END THEN step_index END) AS p FROM w GROUP BY 1, 2, 3),
s2 AS (SELECT s1.run_id, s1.case_id, s1.m, any_value(s1.p) AS p1, min(CASE WHEN step_index > p AND tool_name = CASE s1.m WHEN 0 THEN 'click' ELSE 'purchase' END THEN step_index END) AS p
       FROM s1 JOIN w ON s1.run_id = w.run_id AND s1.case_id = w.case_id GROUP BY 1, 2, 3),
s3 AS (SELECT s2.run_id, s2.case_id, s2.m, any_value(p1) AS p1, any_value(s2.p) AS p2, min(CASE WHEN step_index > p AND tool_name = 'view' THEN step_index END) AS p3
       FROM s2 JOIN w ON s2.run_id = w.run_id AND s2.case_id = w.case_id GROUP BY 1, 2, 3),
ord AS (SELECT run_id, case_id, CASE m WHEN 0 THEN ((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT)::DOUBLE / 3
        ELSE ((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT)::DOUBLE / 2 END AS order_correctness FROM s3)"""


@query("G9_order_correctness", sql(*BASE, ORDER_SQL, "SELECT * FROM ord"))
def order_correctness(lake: Lake) -> DataFrame:
    return trajectory.order_correctness(b.events(lake), expectations(lake), K) \
        .select("run_id", "case_id", "order_correctness")


STATE_SQL = """
st AS (SELECT exp.run_id, exp.case_id, CASE WHEN count(ev.step_index) > 0 THEN 1e0 ELSE 0e0 END AS state_persistence
       FROM exp LEFT JOIN ev ON ev.run_id = exp.run_id AND ev.case_id = exp.case_id AND ev.tool_name = 'signup' AND ev.status = 'success'
       WHERE exp.state GROUP BY 1, 2)"""


@query("G10_state_persistence", sql(*BASE, STATE_SQL, """
SELECT run_id, case_id, CASE WHEN (run_id, case_id) IN (SELECT (run_id, case_id) FROM arts) THEN 1e0 ELSE state_persistence END AS state_persistence
FROM st"""))
def state_persistence(lake: Lake) -> DataFrame:
    return trajectory.state_persistence(
        expectations(lake), b.events(lake), artifacts(lake), K
    ).select("run_id", "case_id", "state_persistence")


READBACK_SQL = """
okc AS (SELECT DISTINCT run_id, case_id, call_id FROM ev WHERE event_type = 'tool_result' AND status = 'success'),
tgt AS (SELECT c.run_id, c.case_id, a.path, c.step_index, c.tool_name = 'view' AS probe, okc.call_id IS NOT NULL AS good
        FROM calls c JOIN arts a ON c.run_id = a.run_id AND c.case_id = a.case_id AND ends_with('w/' || c.k, a.path)
        LEFT JOIN okc ON okc.run_id = c.run_id AND okc.case_id = c.case_id AND okc.call_id = c.call_id WHERE c.known),
pp AS (SELECT run_id, case_id, path, min(CASE WHEN NOT probe THEN step_index END) AS wr, max(CASE WHEN probe AND good THEN step_index END) AS rd FROM tgt GROUP BY 1, 2, 3),
rb AS (SELECT run_id, case_id, count(*) AS produced, count(*) FILTER (WHERE rd > wr) AS verified,
              count(*) FILTER (WHERE rd > wr)::DOUBLE / count(*) AS readback_rate FROM pp WHERE wr IS NOT NULL GROUP BY 1, 2)"""


@query("G12_readback_rate", sql(*BASE, READBACK_SQL, "SELECT * FROM rb"))
def readback_rate(lake: Lake) -> DataFrame:
    return trajectory.readback_rate(expectations(lake), b.events(lake), artifacts(lake), K) \
        .select("run_id", "case_id", "produced", "verified", "readback_rate")


@query("G11_verification_rate", sql(*BASE, READBACK_SQL, """
SELECT exp.run_id, exp.case_id, readback_rate AS verification_rate FROM exp LEFT JOIN rb ON rb.run_id = exp.run_id AND rb.case_id = exp.case_id WHERE exp.verif"""))
def verification_rate(lake: Lake) -> DataFrame:
    return trajectory.verification_rate(expectations(lake), b.events(lake), artifacts(lake), K) \
        .select("run_id", "case_id", "verification_rate")


@query("G13_evidence_level", sql(*BASE, """
SELECT 'u' || (c_custkey % 7) AS run_id, 'c' || c_custkey AS case_id,
       CASE WHEN count(step_index) = 0 THEN 'missing' WHEN bool_or(evidence_level = 'exact') THEN 'exact' ELSE 'coarse' END AS evidence_level
FROM customer LEFT JOIN ev ON user_id = c_custkey GROUP BY c_custkey"""))
def evidence_level(lake: Lake) -> DataFrame:
    key = F.col("c_custkey")
    turns = lake.customer.select(
        F.concat(F.lit("u"), key % 7).alias("run_id"), F.concat(F.lit("c"), key).alias("case_id"),
        F.lit(0).alias("repeat_index"), F.lit(1).alias("turn_index"))
    return trajectory.evidence_level(turns, b.events(lake), K).select("run_id", "case_id", "evidence_level")


STRUCTURED_SQL = """
structured AS (SELECT exp.run_id, exp.case_id, tool_selection, argument_correctness, order_correctness,
   CASE WHEN exp.state THEN CASE WHEN st.state_persistence = 1 OR EXISTS (SELECT 1 FROM arts WHERE arts.run_id = exp.run_id AND arts.case_id = exp.case_id)
        THEN 1e0 ELSE 0e0 END END AS state_persistence,
   CASE WHEN exp.verif THEN readback_rate END AS verification_rate
   FROM exp LEFT JOIN sel ON sel.run_id = exp.run_id AND sel.case_id = exp.case_id
   LEFT JOIN (SELECT run_id, case_id, avg(score) AS argument_correctness FROM scored GROUP BY 1, 2) ac ON ac.run_id = exp.run_id AND ac.case_id = exp.case_id
   LEFT JOIN ord ON ord.run_id = exp.run_id AND ord.case_id = exp.case_id
   LEFT JOIN st ON st.run_id = exp.run_id AND st.case_id = exp.case_id LEFT JOIN rb ON rb.run_id = exp.run_id AND rb.case_id = exp.case_id),
tmw AS (SELECT run_id, round(avg(tool_selection), 6) AS a, round(avg(argument_correctness), 6) AS b, round(avg(order_correctness), 6) AS c,
  round(avg(state_persistence), 6) AS d, round(avg(verification_rate), 6) AS e FROM structured GROUP BY 1),
tm AS (SELECT run_id, unnest(['tool_selection', 'argument_correctness', 'order_correctness', 'state_persistence', 'verification_rate']) AS metric,
       unnest([a, b, c, d, e]) AS value FROM tmw)"""
STRUCTURED = (*BASE, SELECTION_SQL, ARGUMENTS_SQL, ORDER_SQL, STATE_SQL, READBACK_SQL, STRUCTURED_SQL)


@b.shared
def structured(lake: Lake) -> DataFrame:
    rows = b.events(lake)
    return trajectory.score_structured(
        b.event_keys(rows), expectations(lake), rows, assertions(lake), artifacts(lake), K)


@query("G14_structured_scores", sql(*STRUCTURED, "SELECT * FROM structured"))
def structured_scores(lake: Lake) -> DataFrame:
    return structured(lake).select("run_id", "case_id", *TRAJECTORY_METRICS)


def means(lake: Lake) -> DataFrame:
    return trajectory.trajectory_means(structured(lake)).withColumn("value", F.round("value", 6))


@query("G14_trajectory_means", sql(*STRUCTURED, "SELECT * FROM tm"))
def trajectory_means(lake: Lake) -> DataFrame:
    return means(lake)


@query("G15_merge_trajectory", sql(*STRUCTURED, """
SELECT coalesce(tm.run_id, j.run_id) AS run_id, coalesce(tm.metric, j.metric) AS metric, coalesce(tm.value, j.value) AS value
FROM tm FULL JOIN (SELECT DISTINCT run_id, m.metric, 0.5e0 AS value FROM ek, (VALUES ('verification_rate'), ('judge_only')) m(metric)) j
ON tm.run_id = j.run_id AND tm.metric = j.metric"""))
def merge_trajectory(lake: Lake) -> DataFrame:
    judged = b.events(lake).select("run_id").distinct().select(
        "run_id", F.explode(F.array(F.lit("verification_rate"), F.lit("judge_only"))).alias("metric"),
        F.lit(0.5).alias("value"))
    return trajectory.merge_trajectory(means(lake), judged, "hybrid")


@query("G16_deterministic_metrics", sql(*STRUCTURED, "SELECT run_id, metric FROM tm WHERE value IS NOT NULL"))
def deterministic_metrics(lake: Lake) -> DataFrame:
    return trajectory.deterministic_metrics(structured(lake), "hybrid")


@query("G17_normalize_trajectory", sql(b.RUNS_SQL, """,
src AS (SELECT *, row_number() OVER () AS r FROM runs),
parts AS (
  SELECT run_id, 'tool_call' AS event_type, 'coarse' AS evidence_level, 'tool_' || l_returnflag AS name, 1 AS step_index FROM src WHERE tax NOT IN (3, 4)
  UNION ALL SELECT run_id, 'tool_call', 'coarse', 'read', 2 FROM src WHERE tax NOT IN (3, 4)
  UNION ALL SELECT run_id, 'state_change', 'derived', 'workspace_state_change', CASE WHEN tax IN (3, 4) THEN 1 ELSE 3 END FROM src WHERE l_quantity >= 10
  UNION ALL SELECT run_id, 'final', 'exact', 'final_answer', 1 + CASE WHEN tax IN (3, 4) THEN 0 ELSE 2 END + (l_quantity >= 10)::INT FROM src)
SELECT run_id, event_type, evidence_level, name, step_index, count(*) AS n FROM parts GROUP BY 1, 2, 3, 4, 5"""))
def normalize_trajectory(lake: Lake) -> DataFrame:


    rows = b.runs(lake).withColumn("exact_events", F.lit(None).cast(f"array<{EVENT}>"))
    full = trajectory.normalize_trajectory(rows)
    return trajectory.explode_events(full, ["run_id"]).groupBy(
        "run_id", "event_type", "evidence_level", "name", "step_index").agg(F.count(F.lit(1)).alias("n"))


# --- argument expressions -----------------------------------------------------


@query("B12_argument_value", sql(b.EVENTS_SQL, """
SELECT event_id, CASE WHEN value >= 1 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
       CASE WHEN value >= 1 THEN 'x' END AS second, false AS has_third FROM events"""))
def argument_value(lake: Lake) -> DataFrame:
    def at(path: str) -> Column:
        return args.argument_value(F.col("arguments"), F.lit(path))

    rows = b.events(lake)
    return rows.select(
        (F.col("step_index") - 1).alias("event_id"),
        F.try_variant_get(at("k"), "$", "int").alias("k"),
        F.try_variant_get(at("opts.list.1"), "$", "string").alias("second"),
        args.is_present(at("opts.list.2")).alias("has_third"))


@query("B13_value_incomplete", sql(b.EVENTS_SQL, """
SELECT event_id, value > 120 AS incomplete FROM events"""))
def value_incomplete(lake: Lake) -> DataFrame:
    return b.events(lake).select(
        (F.col("step_index") - 1).alias("event_id"),
        args.value_incomplete(F.col("arguments")).alias("incomplete"))


@query("B14_json_equal", sql(b.EVENTS_SQL, """
SELECT event_id, value >= 1 AND json_extract(props, '$.k')::INT = 9 AS is_nine, false AS is_true,
       value >= 1 AND value <= 40 AS is_slow FROM events"""))
def json_equal(lake: Lake) -> DataFrame:
    def at(path: str) -> Column:
        return args.argument_value(F.col("arguments"), F.lit(path))

    return b.events(lake).select(
        (F.col("step_index") - 1).alias("event_id"),
        args.json_equal(at("k"), _json("9.0")).alias("is_nine"),
        args.json_equal(at("k"), _json("true")).alias("is_true"),
        args.json_equal(at("opts.mode"), _json('"slow"')).alias("is_slow"))


@query("B11_sanitize_arguments", """
SELECT doc_id, text AS body, CASE WHEN length(text) > 500 THEN text[:500] || '…[truncated at 500 of ' || length(text) || ' chars]' ELSE text END AS shown,
       '<redacted>' AS api_key, '<redacted>' AS nested_token, lang FROM documents""")
def sanitize_arguments(lake: Lake) -> DataFrame:
    body = F.to_json(F.struct(
        F.col("text").alias("body"), F.col("source").alias("api_key"),
        F.struct(F.col("source").alias("access-token"), F.col("lang").alias("lang")).alias("opts")))
    clean = args.redact_arguments(F.parse_json(body))
    rows = lake.documents.select(
        "doc_id", clean.alias("v"),
        F.get_json_object(args.display_arguments(F.parse_json(body)), "$.body").alias("shown"))

    def at(path: str, name: str) -> Column:
        return F.try_variant_get("v", path, "string").alias(name)

    return rows.select("doc_id", at("$.body", "body"), "shown", at("$.api_key", "api_key"),
                       at("$.opts['access-token']", "nested_token"), at("$.opts.lang", "lang"))
