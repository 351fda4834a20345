"""The given tables seen as evaluation logs.

Each function gives one table of the data model; the text constants say the
same in SQL for the oracle. All rows of the source tables are used.

* cases   ← orders         one case per order
* runs    ← lineitem       one execution per line, in one of two runs
* turns   ← conversations  one scored turn per message
* events  ← events         one tool event per event, a run turn per user
* caseset ← documents      one case per document
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Lake:
    """Reads the given tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._plans = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.plan(name, lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def plan(self, name: str, make) -> DataFrame:
        """One lazy plan per name: parts of a query that read the same table share it."""
        if name not in self._plans:
            self._plans[name] = make()
        return self._plans[name]


def shared(function):
    """A binding built once per query."""
    @wraps(function)
    def once(lake: Lake) -> DataFrame:
        return lake.plan(f"{function.__module__}.{function.__name__}", lambda: function(lake))

    return once


TYPES = ("pos", "amb", "multi", "rej")


def _case_id(key: Column) -> Column:
    kinds = F.array(*[F.lit(t) for t in TYPES])
    return F.concat_ws("-", F.lit("ord"), F.element_at(kinds, (key % 4).cast("int") + 1), key)


def strings(*items: Column | str) -> Column:
    return F.array(*[i if isinstance(i, Column) else F.lit(i) for i in items]).cast("array<string>")


CASES_SQL = """
cases AS (
  SELECT 'ord-' || kind || '-' || o_orderkey AS case_id, kind AS type, o_orderstatus AS dataset,
         CASE kind WHEN 'rej' THEN [] WHEN 'multi' THEN [status2, label] ELSE [label] END AS expected,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high'
              WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'logic'
              WHEN o_orderpriority = '2-HIGH' THEN 'failure'
              WHEN kind <> 'amb' THEN 'artifact' WHEN o_orderstatus = 'O' THEN 'logic'
              ELSE 'trigger' END AS stage,
         label, kind, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey
  FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'amb' WHEN 2 THEN 'multi'
                  ELSE 'rej' END AS kind,
               CASE WHEN o_totalprice < 170000 THEN 'A' WHEN o_totalprice < 340000 THEN 'N'
                    ELSE 'R' END AS label,
               CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS status2
        FROM orders) o
)"""


@shared
def cases(lake: Lake) -> DataFrame:
    """Stage is declared for some cases only; `functions.cases.case_stage` fills the rest."""
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (key % 4).cast("int") + 1)
    price = F.col("o_totalprice")
    label = F.when(price < 170000, "A").when(price < 340000, "N").otherwise("R")
    status = F.when(F.col("o_orderstatus") == "F", "F").otherwise("O")
    priority = F.col("o_orderpriority")
    return lake.orders.select(
        _case_id(key).alias("case_id"), F.col("o_orderstatus").alias("dataset"),
        F.when(kind == "rej", strings()).when(kind == "multi", strings(status, label))
        .otherwise(strings(label)).alias("expected"),
        F.when(priority == "1-URGENT", "critical").when(priority == "2-HIGH", "high")
        .when(priority == "3-MEDIUM", "medium").otherwise("low").alias("severity"),
        F.when((F.col("o_orderstatus") == "P") & (priority == "5-LOW"), "logic").alias("stage"),
        F.when(priority == "2-HIGH", strings("nightly", "Robustness"))
        .otherwise(strings("nightly")).alias("tags"),
        F.when(kind == "pos", strings(F.concat(F.lit("out/"), label, F.lit("-*.csv"))))
        .when(kind == "multi", strings("out/*.csv", "out/[A-N]-?.csv")).otherwise(strings())
        .alias("expect_artifacts"),
        (kind == "rej").alias("forbid_artifacts"),
        F.when(F.col("o_orderstatus") == "O", strings("read", F.concat(F.lit("tool_"), label)))
        .otherwise(strings()).alias("expect_tools"),
        F.when(F.col("o_orderstatus") == "F", strings("in/*")).otherwise(strings())
        .alias("expect_workspace_files"),
        label.alias("label"), key.alias("o_orderkey"), "o_custkey", "o_totalprice",
    )


RUNS_SQL = """
runs AS (
  SELECT 'run-' || l_linestatus AS run_id,
         'ord-' || CASE l_orderkey % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'amb' WHEN 2 THEN 'multi'
                   ELSE 'rej' END || '-' || l_orderkey AS case_id,
         l_linenumber % 3 AS repeat_index, 1 AS turn_index,
         date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) * 10000000 + l_partkey AS line_no,
         CASE WHEN l_quantity < 8 THEN [] WHEN l_quantity > 42 THEN [l_returnflag, l_linestatus]
              ELSE [l_returnflag] END AS selected,
         CASE WHEN l_quantity < 8 THEN NULL ELSE l_returnflag END AS first_selected,
         CASE dis WHEN 10 THEN 'failed' WHEN 9 THEN 'timeout' ELSE 'success' END AS status,
         dis < 9 AS ok,
         CASE WHEN dis = 10 THEN CASE tax WHEN 0 THEN 'network' WHEN 1 THEN 'runtime'
              WHEN 2 THEN 'harness' ELSE 'task' END END AS error_kind,
         CASE WHEN dis = 10 THEN CASE
              WHEN l_quantity < 8 THEN 'Insufficient balance' WHEN l_quantity < 16 THEN 'HTTP 401 Unauthorized'
              WHEN l_quantity < 24 THEN 'getaddrinfo failed' WHEN l_quantity < 32 THEN 'read timed out'
              WHEN l_quantity < 40 THEN 'Rate limit reached' ELSE 'socket hang up' END END AS error,
         CASE WHEN tax = 8 THEN NULL ELSE CAST(l_quantity * 100 AS BIGINT) END AS duration_ms,
         CASE WHEN tax >= 6 THEN NULL ELSE CAST(l_partkey AS DOUBLE) END AS total_tokens,
         CASE WHEN tax >= 7 THEN NULL ELSE CAST(l_suppkey AS DOUBLE) END AS input_tokens,
         CASE WHEN tax >= 8 OR l_linenumber = 1 THEN NULL ELSE l_quantity END AS output_tokens,
         tax, dis, l_quantity, l_returnflag, l_linestatus, l_linenumber, l_suppkey, l_partkey,
         l_orderkey
  FROM (SELECT *, CAST(round(l_discount * 100) AS INTEGER) AS dis,
               CAST(round(l_tax * 100) AS INTEGER) AS tax FROM lineitem) l
)"""


@shared
def runs(lake: Lake) -> DataFrame:
    """Records in the shape of the run log; (case, repeat) may repeat in a run."""
    quantity, flag, line = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linenumber")
    discount = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    failed = discount == 10
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("bigint")
    no_text = F.lit(None).cast("string")
    call = "array<struct<name: string, count: int, failures: int>>"
    count = F.when(line % 3 == 0, F.lit(None)).when(line % 3 == 1, 0).otherwise(line)
    return lake.lineitem.select(
        F.concat(F.lit("run-"), "l_linestatus").alias("run_id"),
        _case_id(F.col("l_orderkey")).alias("case_id"),
        (line % 3).alias("repeat_index"), F.lit(1).alias("turn_index"),
        (day * 10000000 + F.col("l_partkey")).alias("line_no"),
        F.when(quantity < 8, strings()).when(quantity > 42, strings(flag, F.col("l_linestatus")))
        .otherwise(strings(flag)).alias("selected"),
        F.when(failed, "failed").when(discount == 9, "timeout").otherwise("success").alias("status"),
        (discount < 9).alias("ok"),
        F.when(failed, F.when(tax == 0, "network").when(tax == 1, "runtime")
               .when(tax == 2, "harness").otherwise("task")).alias("error_kind"),
        no_text.alias("error_subkind"),
        F.when(failed, F.when(quantity < 8, "Insufficient balance")
               .when(quantity < 16, "HTTP 401 Unauthorized").when(quantity < 24, "getaddrinfo failed")
               .when(quantity < 32, "read timed out").when(quantity < 40, "Rate limit reached")
               .otherwise("socket hang up")).alias("error"),
        F.when(tax != 8, (quantity * 100).cast("bigint")).alias("duration_ms"),
        F.struct(
            F.when(tax < 6, F.col("l_partkey").cast("double")).alias("total_tokens"),
            F.when(tax < 7, F.col("l_suppkey").cast("double")).alias("input_tokens"),
            F.when((tax < 8) & (line != 1), quantity).alias("output_tokens"),
            F.when(tax == 5, F.lit(3.0)).alias("tool_calls_total")).alias("usage"),
        F.when(tax == 3, F.array().cast(call)).when(tax != 4, F.array(
            F.struct(F.concat(F.lit("tool_"), flag).alias("name"), count.alias("count"),
                     F.lit(0).alias("failures")),
            F.struct(F.lit("read").alias("name"), F.lit(1).alias("count"), F.lit(0).alias("failures")))
            .cast(call)).alias("tool_calls"),
        F.when(quantity < 10, F.array().cast(
            "array<struct<path: string, sha256: string, size_bytes: bigint, mime_type: string, "
            "change: string, text_excerpt: string>>"))
        .otherwise(F.array(F.struct(
            F.concat(F.lit("out/"), flag, F.lit("-"), line, F.lit(".csv")).alias("path"),
            F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"),
            F.when(quantity < 14, F.lit(0)).otherwise(F.col("l_suppkey") + 1).cast("bigint")
            .alias("size_bytes"),
            F.when(tax == 0, "text/plain").when(tax > 2, "text/csv").alias("mime_type"),
            F.lit("created").alias("change"), F.lit("a,b").alias("text_excerpt")))).alias("artifacts"),
        F.when(line % 2 == 0, strings("in/data.csv")).otherwise(strings("tmp/x")).alias("workspace_files"),
        strings(flag, F.col("l_linestatus")).alias("loaded_skills"),
        F.concat(F.lit("s-"), F.col("l_orderkey")).alias("session_id"),
        F.concat(F.lit("openai/M"), F.col("l_suppkey") % 3).alias("model"),
        F.when(tax > 4, F.concat(F.lit("hub/m"), F.col("l_suppkey") % 5)).alias("resolved_model"),
        no_text.alias("raw_output"), no_text.alias("reasoning"), no_text.alias("final_answer"),
        no_text.alias("request_id"), no_text.alias("skip_reason"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag",
    )


TURNS_SQL = """
turns AS (
  SELECT 'run' || (conv_id % 3) AS run_id, 'conv-' || conv_id AS case_id, 0 AS repeat_index,
         turn + 1 AS turn_index, turn + 1 AS line_no,
         CASE WHEN turn >= 3 AND length(text) % 5 = 0 THEN 's2' ELSE 's1' END AS session_id,
         role, text,
         CASE WHEN turn >= 2 AND length(text) % 7 = 0 THEN 'skipped'
              WHEN length(text) % 4 = 0 THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN length(text) % 8 = 0 AND turn = 1 THEN 'network'
              WHEN length(text) % 4 = 0 THEN 'task' END AS error_kind,
         CASE WHEN role = 'system' THEN 'multi' WHEN role = 'user' THEN 'pos' ELSE 'amb' END AS type,
         CASE WHEN length(text) % 3 = 0 THEN 'artifact' ELSE 'logic' END AS stage,
         CASE WHEN length(text) % 2 = 0 THEN 'critical' ELSE 'medium' END AS severity,
         turn >= 2 AS requires_context, turn >= 2 AND length(text) % 7 = 0 AS skipped,
         length(text) % 4 <> 0 AND NOT (turn >= 2 AND length(text) % 7 = 0) AS ok,
         length(text) % 3 <> 1 AS skill_injected,
         4 - length(text) % 2 AS art_hits, 4 AS art_total,
         CASE WHEN role = 'user' THEN 2 ELSE 0 END AS tool_hits,
         CASE WHEN role = 'user' THEN 2 ELSE 0 END AS tool_total,
         CASE WHEN length(text) % 9 = 0 THEN 0 ELSE 1 END AS workspace_hits, 1 AS workspace_total,
         length(text) % 6 AS n_artifacts,
         (length(text) % 4 <> 0 AND NOT (turn >= 2 AND length(text) % 7 = 0))
           AND length(text) % 2 = 0 AND length(text) % 9 <> 0 AS done
  FROM conversations
)"""


@shared
def turns(lake: Lake) -> DataFrame:
    """Scored turns: the output shape of `execution.score_turns`."""
    n, turn, role = F.length("text"), F.col("turn"), F.col("role")
    skipped = (turn >= 2) & (n % 7 == 0)
    failed = n % 4 == 0
    tools = F.when(role == "user", 2).otherwise(0)
    facts = lake.conversations.select(
        F.concat(F.lit("run"), F.col("conv_id") % 3).alias("run_id"),
        F.concat(F.lit("conv-"), "conv_id").alias("case_id"), F.lit(0).alias("repeat_index"),
        (turn + 1).alias("turn_index"), (turn + 1).alias("line_no"),
        F.when((turn >= 3) & (n % 5 == 0), "s2").otherwise("s1").alias("session_id"),
        "role", "text",
        F.when(skipped, "skipped").when(failed, "failed").otherwise("success").alias("status"),
        F.when((n % 8 == 0) & (turn == 1), "network").when(failed, "task").alias("error_kind"),
        F.when(role == "system", "multi").when(role == "user", "pos").otherwise("amb").alias("type"),
        F.when(n % 3 == 0, "artifact").otherwise("logic").alias("stage"),
        F.when(n % 2 == 0, "critical").otherwise("medium").alias("severity"),
        (turn >= 2).alias("requires_context"), skipped.alias("skipped"),
        (~failed & ~skipped).alias("ok"), (n % 3 != 1).alias("skill_injected"),
        (4 - n % 2).alias("art_hits"), F.lit(4).alias("art_total"),
        tools.alias("tool_hits"), tools.alias("tool_total"),
        F.when(n % 9 == 0, 0).otherwise(1).alias("workspace_hits"), F.lit(1).alias("workspace_total"),
        (n % 6).alias("n_artifacts"))
    return facts.withColumn(
        "done", F.col("ok") & (F.col("art_hits") == F.col("art_total"))
        & (F.col("workspace_hits") == F.col("workspace_total")))


EVENT_KEYS = ["run_id", "case_id", "repeat_index", "turn_index"]

EVENTS_SQL = """
ev AS (
  SELECT 'u' || (user_id % 7) AS run_id, 'c' || user_id AS case_id,
         0 AS repeat_index, 1 AS turn_index,
         event_id + 1 AS step_index, event_type AS tool_name,
         CASE WHEN event_type = 'error' THEN 'tool_result' WHEN event_type = 'signup' THEN 'state_change'
              ELSE 'tool_call' END AS event_type,
         'k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS call_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CASE WHEN user_id % 5 = 0 THEN 'coarse' ELSE 'exact' END AS evidence_level,
         CASE WHEN value < 3 THEN 'failed' ELSE 'success' END AS status, value, user_id
  FROM events
), ek AS (SELECT DISTINCT run_id, case_id, repeat_index, turn_index, user_id FROM ev)"""


@shared
def events(lake: Lake) -> DataFrame:
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    rows = lake.events.select(
        F.concat(F.lit("u"), user % 7).alias("run_id"), F.concat(F.lit("c"), user).alias("case_id"),
        F.lit(0).alias("repeat_index"), F.lit(1).alias("turn_index"), (F.col("event_id") + 1).alias("step_index"),
        kind.alias("tool_name"),
        F.when(kind == "error", "tool_result").when(kind == "signup", "state_change")
        .otherwise("tool_call").alias("event_type"),
        F.concat(F.lit("k"), k).alias("call_id"), k.alias("k"),
        F.when(user % 5 == 0, "coarse").otherwise("exact").alias("evidence_level"),
        F.when(F.col("value") < 3, "failed").otherwise("success").alias("status"), "value", user)
    return rows.withColumn("arguments", event_arguments())


def event_arguments() -> Column:
    """{"k": n, "path": "w/<n>", "opts": {"mode": ..., "list": [n, true]}}; missing on some calls."""
    mode = F.when(F.col("value") > 120, F.lit("<redacted>")).when(F.col("value") > 40, "fast") \
        .otherwise("slow")
    body = F.struct(
        F.col("k").alias("k"), F.concat(F.lit("w/"), "k").alias("path"),
        F.struct(mode.alias("mode"), F.array(F.col("k").cast("string"), F.lit("x")).alias("list"))
        .alias("opts"))
    return F.when(F.col("value") >= 1, F.to_variant_object(body))


def event_keys(rows: DataFrame) -> DataFrame:
    return rows.select(*EVENT_KEYS, "user_id").distinct()


CASESET_SQL = """
caseset AS (
  SELECT lang AS set_id, doc_id AS line_no,
         (CASE WHEN kind = 'rej' AND n_chars % 3 = 0 THEN 'none' ELSE source END) || '-' || kind || '-'
           || CAST(n_chars AS VARCHAR) AS id,
         text AS prompt, kind,
         CASE WHEN kind = 'rej' THEN CASE WHEN n_chars % 5 = 0 THEN [source] ELSE [] END
              WHEN kind = 'multi' THEN CASE WHEN n_chars % 2 = 0 THEN [source, 'src0'] ELSE [source, source] END
              WHEN n_chars % 11 = 0 THEN [] ELSE [source] END AS gold,
         source, n_chars, doc_id
  FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'amb' WHEN 2 THEN 'multi' ELSE 'rej' END AS kind
        FROM documents) d
)"""


@shared
def caseset(lake: Lake) -> DataFrame:
    n, source = F.col("n_chars"), F.col("source")
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("doc_id") % 4).cast("int") + 1)
    gold = (
        F.when(kind == "rej", F.when(n % 5 == 0, strings(source)).otherwise(strings()))
        .when(kind == "multi", F.when(n % 2 == 0, strings(source, "src0")).otherwise(strings(source, source)))
        .when(n % 11 == 0, strings()).otherwise(strings(source)))
    scope = F.when((kind == "rej") & (n % 3 == 0), F.lit("none")).otherwise(source)
    return lake.documents.select(
        F.col("lang").alias("set_id"), F.col("doc_id").alias("line_no"),
        F.concat_ws("-", scope, kind, n).alias("id"), F.col("text").alias("prompt"),
        kind.alias("kind"), gold.alias("gold"), "source", "n_chars", "doc_id")


JUDGED_SQL = """
judged AS (
  SELECT 'cal' AS calibration_id, 'judge' || (l.doc_id % 2) AS judge_id, 'doc-' || l.doc_id AS case_id,
         0 AS repeat_index, 1 AS turn_index, CASE WHEN d.lang = 'en' THEN 'faithfulness' ELSE 'relevancy' END AS dimension,
         d.lang AS assertion, l.quality = 1 AS human_passed, d.n_chars >= 300 AS judge_passed,
         CAST(l.quality AS DOUBLE) AS human_score, least(1e0, d.n_chars / 2000e0) AS judge_score,
         l.toxic = 1 AS failed, l.doc_id, d.source, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


@shared
def judged(lake: Lake) -> DataFrame:
    """One human and one machine judgement per labelled document; toxic ones are failed calls."""
    docs = lake.documents.select("doc_id", "lang", "source", "n_chars")
    return lake.labels.join(docs, "doc_id").select(
        F.lit("cal").alias("calibration_id"),
        F.concat(F.lit("judge"), F.col("doc_id") % 2).alias("judge_id"),
        F.concat(F.lit("doc-"), "doc_id").alias("case_id"), F.lit(0).alias("repeat_index"),
        F.lit(1).alias("turn_index"),
        F.when(F.col("lang") == "en", "faithfulness").otherwise("relevancy").alias("dimension"),
        F.col("lang").alias("assertion"), (F.col("quality") == 1).alias("human_passed"),
        (F.col("n_chars") >= 300).alias("judge_passed"),
        F.col("quality").cast("double").alias("human_score"),
        F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("judge_score"),
        (F.col("toxic") == 1).alias("failed"), "doc_id", "source", "n_chars")


SCORES_SQL = """
scores AS (
  SELECT CAST(o_orderpriority AS VARCHAR) AS run_id, 'm_' || o_orderstatus AS metric,
         avg(CASE WHEN o_totalprice > 250000 THEN 1e0 ELSE 0e0 END) AS value
  FROM orders WHERE NOT (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P') GROUP BY 1, 2
)"""


@shared
def scores(lake: Lake) -> DataFrame:
    """(run_id, metric, value) with one metric one run does not have."""
    known = ~((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "P"))
    return lake.orders.filter(known).groupBy(
        F.col("o_orderpriority").alias("run_id"),
        F.concat(F.lit("m_"), "o_orderstatus").alias("metric")).agg(
        F.avg(F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0)).alias("value"))
