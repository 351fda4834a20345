"""Queries on case sets, catalogs, text expressions and suggestion checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalgrain.functions import cases as case_functions, text
from evalgrain.operators import caseset, evidence, joins, ordered
from evalgrain.plans import bindings as b
from evalgrain.plans.bindings import Lake
from evalgrain.plans.catalog import query, sql

# --- expressions --------------------------------------------------------------


@query("B1_case_type", sql(b.CASESET_SQL, """
SELECT line_no, id, kind AS type, '?' AS bare FROM caseset"""))
def case_type(lake: Lake) -> DataFrame:
    return b.caseset(lake).select(
        "line_no", "id", text.case_type(F.col("id")).alias("type"),
        text.case_type(F.col("source")).alias("bare"))


@query("B2_case_stage", sql(b.CASES_SQL, "SELECT case_id, stage FROM cases"))
def case_stage(lake: Lake) -> DataFrame:
    return b.cases(lake).select("case_id", case_functions.case_stage(
        F.col("stage"), F.col("tags"), (F.size("expect_artifacts") > 0) | F.col("forbid_artifacts"),
        F.size("expect_tools") > 0).alias("stage"))


@query("B3_resolve_turns", """
SELECT o_orderkey AS id, CAST(t.t AS INTEGER) AS turn_index, CASE t.t WHEN 1 THEN o_orderpriority ELSE 'again ' || o_orderpriority END AS prompt,
       CASE WHEN t.t = 2 THEN o_orderstatus END AS reference, t.t = 2 AS requires_context
FROM orders, range(1, 4) t(t) WHERE t.t <= CASE o_orderstatus WHEN 'F' THEN 1 ELSE 3 END""")
def resolve_turns(lake: Lake) -> DataFrame:
    again = F.concat(F.lit("again "), "o_orderpriority")
    turn = "struct<prompt: string, reference: string, requires_context: boolean>"
    turns = F.array(
        F.struct(again.alias("prompt"), F.col("o_orderstatus").alias("reference"),
                 F.lit(True).alias("requires_context")),
        F.struct(again.alias("prompt"), F.lit(None).cast("string").alias("reference"),
                 F.lit(False).alias("requires_context"))).cast(f"array<{turn}>")
    cases = lake.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prompt"),
        F.lit(None).cast("string").alias("reference"), F.lit(None).cast("boolean").alias("requires_context"),
        F.when(F.col("o_orderstatus") != "F", turns).alias("turns"))
    return joins.resolve_turns(cases)


@query("B4_normalize_prompt", r"""
SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS prompt FROM documents""")
def normalize_prompt(lake: Lake) -> DataFrame:
    return lake.documents.select("doc_id", text.normalize_prompt(F.col("text")).alias("prompt"))


@query("B15_model_identity", """
SELECT c_custkey, lower(c_name) AS identity FROM customer""")
def model_identity(lake: Lake) -> DataFrame:
    name = F.concat(F.lit("  Provider/"), "c_mktsegment", F.lit("/"), "c_name", F.lit("// "))
    return lake.customer.select("c_custkey", text.model_identity(name).alias("identity"))


@query("B16_slug", """
SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (
  SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._+-]', '-', 'g'), '-') AS s FROM pages) x
UNION ALL SELECT page_id, 'unknown' FROM pages""")
def slug(lake: Lake) -> DataFrame:
    blank = lake.pages.select("page_id", text.slug(F.lit("//")).alias("slug"))
    return lake.pages.select("page_id", text.slug(F.col("url")).alias("slug")).unionByName(blank)


@query("B17_content_hash", """
SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 16) AS content_hash, 'sha256:' || sha256(text) AS full_hash FROM documents""")
def content_hash(lake: Lake) -> DataFrame:
    return lake.documents.select(
        "doc_id", text.content_hash(F.col("text")).alias("content_hash"),
        text.full_hash(F.col("text")).alias("full_hash"))


@query("B17_config_hash", """
SELECT c_nationkey, count(DISTINCT (c_mktsegment, c_acctbal > 5000)) AS setups, count(*) AS runs FROM customer GROUP BY 1""")
def config_hash(lake: Lake) -> DataFrame:
    suite = F.struct(
        F.col("c_name").alias("suite_id"), F.col("c_mktsegment").alias("dataset"),
        F.lit(1).alias("parallelism"),
        F.struct(F.lit("v1").alias("cfg"), F.col("c_name").alias("target")).alias("skills"))
    rows = lake.customer.withColumn("suite", suite).withColumn("h", case_functions.config_hash(
        F.col("suite"), ["suite_id", "dataset", "parallelism", "skills.cfg", "skills.target"],
        F.lit("m"), F.col("c_acctbal") > 5000, F.lit("rt"), F.lit("env"),
        F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.lit("d")))
    return rows.groupBy("c_nationkey").agg(
        F.count_distinct("h").alias("setups"), F.count(F.lit(1)).alias("runs"))


@query("B18_parse_selection", """
SELECT doc_id, doc_id % 3 <> 2 AS parsed, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' END AS selected,
       CASE WHEN doc_id % 3 = 0 THEN text END AS reasoning FROM documents""")
def parse_selection(lake: Lake) -> DataFrame:
    answer = F.to_json(F.struct(
        F.array(F.lit("nobody"), F.col("source")).alias("selected_skills"), F.col("text").alias("reasoning")))
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))) \
        .when(kind == 1, F.lit('so: {"selected_skills": ["nobody"], "reasoning": ""} ok')) \
        .otherwise(F.concat(F.lit("no braces "), F.regexp_replace("text", r"[{}]", "")))
    parsed = text.parse_selection(raw, F.array("source", F.lit("src0")))
    return lake.documents.select("doc_id", parsed.alias("p")).select(
        "doc_id", "p.parsed", F.array_join("p.selected", ",").alias("selected"), "p.reasoning")


@query("B19_extract_reply", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(10) || lang WHEN 1 THEN text WHEN 2 THEN text WHEN 3 THEN text ELSE 'plain ' || text END AS reply
FROM documents""")
def extract_reply(lake: Lake) -> DataFrame:
    kind, body = F.col("doc_id") % 5, F.col("text")
    raw = (
        F.when(kind == 0, F.to_json(F.struct(F.array(
            F.struct(body.alias("text")), F.struct(F.col("lang").alias("text"))).alias("payloads"))))
        .when(kind == 1, F.to_json(F.struct(F.lit("  ").alias("text"), body.alias("reply"))))
        .when(kind == 2, F.to_json(F.struct(F.struct(body.alias("content")).alias("message"))))
        .when(kind == 3, F.to_json(F.struct(F.lit(3).alias("text"), body.alias("response"))))
        .otherwise(F.concat(F.lit("plain "), body)))
    return lake.documents.select("doc_id", text.extract_reply(raw).alias("reply"))


@query("B20_extract_meta", """
SELECT doc_id, 'read,' || lang AS tools, CAST(n_chars AS DOUBLE) AS total_tokens, CAST(NULL AS DOUBLE) AS input_tokens, 3e0 AS tool_calls_total,
       source AS loaded, CASE WHEN doc_id % 2 = 0 THEN '?/' || lang END AS resolved_model FROM documents""")
def extract_meta(lake: Lake) -> DataFrame:
    meta = F.struct(
        F.struct(
            F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("model"),
            F.struct(F.col("n_chars").alias("total")).alias("usage")).alias("agentMeta"),
        F.struct(F.array(F.lit("read"), "lang").alias("tools"), F.lit(3).alias("calls")).alias("toolSummary"),
        F.struct(F.struct(F.array(F.struct(F.col("source").alias("name"))).alias("entries")).alias("skills"))
        .alias("systemPromptReport"))
    raw = F.to_json(F.struct(F.col("text").alias("text"), meta.alias("meta")))
    return lake.documents.select("doc_id", text.extract_meta(raw).alias("m")).select(
        "doc_id", F.array_join("m.tools", ",").alias("tools"), "m.usage.total_tokens", "m.usage.input_tokens",
        "m.usage.tool_calls_total", F.array_join("m.loaded_skills", ",").alias("loaded"), "m.resolved_model")


@query("B21_quote_in", """
SELECT doc_id, CASE WHEN text IS NOT NULL THEN NOT (doc_id % 2 = 1 OR length(text) <= 60) END AS found FROM documents""")
def quote_in(lake: Lake) -> DataFrame:
    part = F.substring("text", 11, 40)
    quote = F.concat(F.lit("**"), F.replace(part, F.lit(" "), F.lit(" \n ")),
                     F.when((F.col("doc_id") % 2 == 0) & (F.length("text") > 60), "`").otherwise("§§"))
    return lake.documents.select(
        "doc_id", text.quote_in(quote, F.col("text")).alias("found"))


@query("B22_truncate", """
SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || chr(10) || '…[truncated at 1200 chars]' ELSE text END AS excerpt FROM documents""")
def truncate(lake: Lake) -> DataFrame:
    return lake.documents.select(
        "doc_id", text.truncated(F.col("text"), 1200).alias("excerpt"))


@query("B23_version_order", """
SELECT p_brand, arg_min('v' || p_size || '.' || (p_partkey % 3), p_size * 10 + p_partkey % 3) AS smallest,
       arg_max('v' || p_size || '.' || (p_partkey % 3), p_size * 10 + p_partkey % 3) AS largest FROM part GROUP BY 1""")
def version_order(lake: Lake) -> DataFrame:
    rows = lake.part.select("p_brand", F.concat(
        F.lit("v"), "p_size", F.lit("."), F.col("p_partkey") % 3).alias("version"))
    order = text.version_order(F.col("version"))
    low = ordered.first_of(rows.withColumn("smallest", F.col("version")), ["p_brand"], order, ["smallest"])
    high = ordered.last_of(rows.withColumn("largest", F.col("version")), ["p_brand"], order, ["largest"])
    return low.join(high, "p_brand")


@query("B24_expectation_checks", """
SELECT p_partkey, problem FROM (SELECT p_partkey, unnest([
   CASE WHEN p_size % 10 = 0 THEN 'not exactly one matcher' END, CASE WHEN p_size % 10 = 1 THEN 'secret path' END,
   CASE WHEN p_size % 10 = 2 THEN 'content value stored' END, CASE WHEN p_size % 10 = 3 THEN 'gold value too long' END,
   CASE WHEN p_size % 10 = 4 THEN 'bad path' END]) AS problem FROM part) x WHERE problem IS NOT NULL""")
def expectation_checks(lake: Lake) -> DataFrame:
    size = F.col("p_size") % 10
    value = F.when(size == 3, F.repeat("p_name", 40)).otherwise(F.col("p_name"))
    rows = lake.part.select(
        "p_partkey", F.lit(0).alias("assertion_index"), F.lit("write").alias("tool"),
        F.when(size == 1, "opts.API-Key").when(size == 2, "opts.body").when(size == 4, "a..b")
        .otherwise("opts.format").alias("path"),
        F.when(size == 0, True).alias("required"), F.lit(None).cast("boolean").alias("forbidden"),
        F.to_variant_object(F.struct(value.alias("v"))).alias("_v"),
        F.lit(None).cast("array<variant>").alias("in_values"), F.lit(None).cast("string").alias("matches"),
    ).withColumn("equals", F.try_variant_get("_v", "$.v", "variant"))
    return caseset.expectation_problems(rows).select("p_partkey", "problem")


@query("B24_regex_and_repeat_checks", """
SELECT p_partkey, 'regex does not compile' AS problem FROM part WHERE p_size % 10 = 5
UNION ALL SELECT p_partkey, 'assertion repeated' FROM part WHERE p_size % 10 = 6""")
def regex_and_repeat_checks(lake: Lake) -> DataFrame:
    size = F.col("p_size") % 10
    copies = F.when(size == 6, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = lake.part.select(
        "p_partkey", F.explode(copies).alias("assertion_index"), F.lit("write").alias("tool"),
        F.lit("opts.name").alias("path"), F.lit(None).cast("boolean").alias("required"),
        F.lit(None).cast("boolean").alias("forbidden"), F.lit(None).cast("variant").alias("equals"),
        F.lit(None).cast("array<variant>").alias("in_values"),
        F.when(size == 5, F.concat("p_brand", F.lit("("))).otherwise(F.concat("p_brand", F.lit("$"))).alias("matches"))
    return caseset.regex_problems(rows).select("p_partkey", "problem").unionByName(
        caseset.repeated_assertions(rows, ["p_partkey"]))


@query("B24_tool_list_checks", """
SELECT o_orderkey, problem FROM (SELECT o_orderkey, unnest([
   CASE WHEN o_orderpriority = '1-URGENT' THEN 'required_tools repeated' END,
   CASE WHEN o_orderpriority = '2-HIGH' THEN 'required and forbidden overlap' END,
   CASE WHEN o_orderstatus = 'P' THEN 'verification without probe tools' END]) AS problem FROM orders) x WHERE problem IS NOT NULL""")
def tool_list_checks(lake: Lake) -> DataFrame:
    priority = F.col("o_orderpriority")
    rows = lake.orders.select(
        "o_orderkey", F.when(priority == "1-URGENT", b.strings("read", "read")).otherwise(b.strings("read"))
        .alias("required_tools"),
        F.when(priority == "2-HIGH", b.strings("read")).otherwise(b.strings("rm")).alias("forbidden_tools"),
        F.lit(True).alias("required_verification"),
        F.when(F.col("o_orderstatus") != "P", b.strings("stat")).alias("verification_tools"))
    return caseset.tool_list_problems(rows).select("o_orderkey", "problem")


@query("B25_inline_secrets", """
SELECT c_custkey AS config_id, path FROM (SELECT c_custkey, unnest([
   'suite.models[1].api_key', CASE WHEN c_mktsegment = 'BUILDING' THEN 'suite.db.Pass-Password' END]) AS path FROM customer) x WHERE path IS NOT NULL""")
def inline_secrets(lake: Lake) -> DataFrame:
    config = F.to_json(F.struct(
        F.array(
            F.struct(F.lit("X").alias("api_key_env"), F.lit(None).cast("string").alias("api_key")),
            F.struct(F.lit("X").alias("api_key_env"), F.col("c_name").alias("api_key"))).alias("models"),
        F.struct(F.when(F.col("c_mktsegment") == "BUILDING", "p").alias("Pass-Password"),
                 F.lit("c").alias("credential_id")).alias("db")))
    configs = lake.customer.select(F.col("c_custkey").alias("config_id"), F.parse_json(config).alias("config"))
    return caseset.inline_secrets(configs).select("config_id", "path")


@query("B27_normalize_tags", sql(b.CASESET_SQL, """
SELECT line_no, CASE kind WHEN 'pos' THEN 'positive' WHEN 'amb' THEN 'ambiguous' WHEN 'rej' THEN 'no-skill' ELSE 'multi-skill' END AS tags FROM caseset"""))
def normalize_tags(lake: Lake) -> DataFrame:
    return b.caseset(lake).select("line_no", F.array_join(case_functions.canonical_tags(
        text.case_type(F.col("id")), b.strings("free text")), ",").alias("tags"))


@query("B29_catalog_text", """
SELECT run_id, string_agg(line, chr(10) ORDER BY skill_id) AS catalog FROM (
  SELECT DISTINCT l_orderkey AS run_id, 'part-' || l_partkey AS skill_id,
         '- part-' || l_partkey || ': about ' || p_name || CASE WHEN p_size > 25 THEN ' 触发词: ' || p_brand || ', ' || p_type ELSE '' END
         || CASE WHEN p_size <= 10 THEN '  排除: x' ELSE '' END AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey) y GROUP BY run_id""")
def catalog_text(lake: Lake) -> DataFrame:
    skills = lake.part.select(
        "p_partkey", F.concat(F.lit("about "), "p_name").alias("description"),
        F.when(F.col("p_size") > 25, F.array("p_brand", "p_type")).otherwise(b.strings()).alias("triggers"),
        F.when(F.col("p_size") <= 10, b.strings("x")).otherwise(b.strings()).alias("exclusions"))
    shown = lake.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("p_partkey")) \
        .distinct().join(skills, "p_partkey") \
        .withColumn("skill_id", F.concat(F.lit("part-"), "p_partkey"))
    return joins.catalog_text(shown, ["run_id"])


# --- catalogs -----------------------------------------------------------------


def skills(lake: Lake) -> DataFrame:
    return lake.part.select(
        F.col("p_type").alias("root"), F.col("p_brand").alias("skill_id"),
        F.concat(F.lit("v"), "p_size").alias("version")).distinct() \
        .withColumn("content_hash", F.sha2(F.concat_ws("|", "root", "skill_id", "version"), 256))


def settings(lake: Lake) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """runs, pins, include, exclude of each supplier."""
    nation, run = F.col("s_nationkey"), F.col("s_name").alias("run_id")
    runs = lake.supplier.select(
        run, F.when(nation > 12, "ECONOMY").otherwise("SMALL").alias("root"),
        F.when(F.col("s_acctbal") < 0, "none").otherwise("full").alias("mode"))
    pins = lake.supplier.filter("s_acctbal > 5000").select(
        run, F.lit("Brand#1").alias("skill_id"), F.lit("v7").alias("version"))
    include = lake.supplier.filter("s_nationkey < 5").select(
        run, F.explode(F.array(F.lit("Brand#1"), F.lit("Brand#2"), F.lit("Brand#99"))).alias("skill_id"))
    exclude = lake.supplier.filter("s_nationkey > 20").select(run, F.lit("Brand#2").alias("skill_id"))
    return runs, pins, include, exclude


@query("C10_resolve_catalog", """
WITH sk AS (SELECT DISTINCT p_type AS root, p_brand AS skill_id, p_size FROM part),
low AS (SELECT root, skill_id, min(p_size) AS v FROM sk GROUP BY 1, 2),
r AS (SELECT s_name AS run_id, CASE WHEN s_nationkey > 12 THEN 'ECONOMY' ELSE 'SMALL' END AS root, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal >= 0),
c AS (SELECT run_id, r.root, skill_id, CASE WHEN skill_id = 'Brand#1' AND s_acctbal > 5000 THEN 7 ELSE v END AS v FROM r JOIN low ON r.root = low.root
      WHERE (s_nationkey >= 5 OR skill_id IN ('Brand#1', 'Brand#2')) AND NOT (s_nationkey > 20 AND skill_id = 'Brand#2'))
SELECT run_id, c.skill_id, 'v' || c.v AS version FROM c JOIN sk ON sk.root = c.root AND sk.skill_id = c.skill_id AND sk.p_size = c.v""")
def resolve_catalog(lake: Lake) -> DataFrame:
    runs, pins, include, exclude = settings(lake)
    return joins.resolve_catalog(runs, skills(lake), pins, include, exclude) \
        .select("run_id", "skill_id", "version")


@query("C10_catalog_violations", """
WITH r AS (SELECT s_name AS run_id, CASE WHEN s_nationkey > 12 THEN 'ECONOMY' ELSE 'SMALL' END AS root, s_nationkey, s_acctbal FROM supplier),
named AS (SELECT run_id, root, 'Brand#1' AS skill_id, 'unknown pinned skill' AS problem FROM r WHERE s_acctbal > 5000
  UNION ALL SELECT run_id, root, unnest(['Brand#1', 'Brand#2', 'Brand#99']), 'unknown included skill' FROM r WHERE s_nationkey < 5
  UNION ALL SELECT run_id, root, 'Brand#2', 'unknown excluded skill' FROM r WHERE s_nationkey > 20)
SELECT run_id, skill_id, problem FROM named WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_type = root AND p_brand = skill_id)
UNION ALL SELECT run_id, 'Brand#1', 'unknown version' FROM r WHERE s_acctbal > 5000
  AND EXISTS (SELECT 1 FROM part WHERE p_type = root AND p_brand = 'Brand#1')
  AND NOT EXISTS (SELECT 1 FROM part WHERE p_type = root AND p_brand = 'Brand#1' AND p_size = 7)""")
def catalog_violations(lake: Lake) -> DataFrame:
    runs, pins, include, exclude = settings(lake)
    return joins.catalog_violations(runs, skills(lake), pins, include, exclude)


@query("C12_version_drift", """
WITH h AS (SELECT l_linestatus AS root, l_returnflag AS skill_id, CASE WHEN l_linenumber = 1 THEN 'v1' ELSE 'v' || l_linenumber END AS version,
                  'h' || CAST(l_quantity AS INTEGER) AS old_hash, l_orderkey AS run_id FROM lineitem),
c AS (SELECT 'F' AS root, CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS skill_id, 'v' || (n_nationkey % 7 + 1) AS version,
             'h' || n_nationkey AS new_hash FROM nation)
SELECT h.root, h.skill_id, h.version, old_hash, new_hash, count(DISTINCT run_id) AS runs, min(run_id) AS first_run
FROM h JOIN c ON h.root = c.root AND h.skill_id = c.skill_id AND h.version = c.version WHERE old_hash <> new_hash GROUP BY 1, 2, 3, 4, 5""")
def version_drift(lake: Lake) -> DataFrame:
    line = F.col("l_linenumber")
    history = lake.lineitem.select(
        F.col("l_linestatus").alias("root"), F.col("l_returnflag").alias("skill_id"),
        F.when(line > 1, F.concat(F.lit("v"), line)).alias("version"),
        F.concat(F.lit("h"), F.col("l_quantity").cast("int")).alias("content_hash"),
        F.col("l_orderkey").alias("run_id"))
    key = F.col("n_nationkey")
    current = lake.nation.select(
        F.lit("F").alias("root"), F.element_at(b.strings("A", "N", "R"), key % 3 + 1).alias("skill_id"),
        F.concat(F.lit("v"), key % 7 + 1).alias("version"), F.concat(F.lit("h"), key).alias("content_hash"))
    return joins.version_drift(history, current)


@query("C7_diff_case_sets", r"""
WITH l AS (SELECT 'd' || d.doc_id AS id, text AS p, source AS g FROM documents d JOIN labels USING (doc_id)),
r AS (SELECT 'd' || d.doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p, CASE WHEN lang = 'en' THEN source ELSE source || '|' || lang END AS g
      FROM documents d JOIN pages ON doc_id = page_id)
SELECT coalesce(l.id, r.id) AS case_id, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'missing' WHEN l.p <> r.p AND l.g <> r.g THEN 'prompt+gold'
       WHEN l.p <> r.p THEN 'prompt' ELSE 'gold' END AS kind, l.g AS reference_gold, r.g AS candidate_gold
FROM l FULL JOIN r ON l.id = r.id WHERE l.id IS NULL OR r.id IS NULL OR l.p <> r.p OR l.g <> r.g""")
def diff_case_sets(lake: Lake) -> DataFrame:
    docs = lake.documents
    reference = docs.join(lake.labels.select("doc_id"), "doc_id").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("prompt"),
        F.array("source").alias("gold"), F.col("doc_id").alias("line_no"))
    candidate = docs.join(lake.pages.select(F.col("page_id").alias("doc_id")), "doc_id").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("prompt"),
        F.when(F.col("lang") == "en", F.array("source")).otherwise(F.array("source", "lang")).alias("gold"),
        F.col("doc_id").alias("line_no"))
    return joins.diff_case_sets(reference, candidate).select(
        "case_id", "kind", F.array_join("reference_gold", "|").alias("reference_gold"),
        F.array_join("candidate_gold", "|").alias("candidate_gold"))


# --- case-set quality ---------------------------------------------------------


@query("M1_dup_case_ids", sql(b.CASESET_SQL, """
SELECT set_id, id, count(*) AS n FROM caseset GROUP BY 1, 2 HAVING count(*) > 1"""))
def dup_case_ids(lake: Lake) -> DataFrame:
    return caseset.duplicate_ids(b.caseset(lake))


PROMPT_SQL = r"""
np AS (SELECT *, lower(trim(regexp_replace(prompt, '\s+', ' ', 'g'))) AS norm FROM caseset),
dp AS (SELECT set_id, id, line_no, first_value(id) OVER w AS first_id, first_value(line_no) OVER w AS first_line,
   CASE WHEN gold = first_value(gold) OVER w THEN 'duplicate prompt' ELSE 'same prompt, other gold' END AS problem FROM np
   WINDOW w AS (PARTITION BY set_id, norm ORDER BY line_no))"""


@query("M2_dup_prompts", sql(b.CASESET_SQL, PROMPT_SQL, """
SELECT set_id, id, line_no, first_id, problem FROM dp WHERE line_no <> first_line"""))
def dup_prompts(lake: Lake) -> DataFrame:
    return caseset.duplicate_prompts(b.caseset(lake))


ID_SQL = """
idp AS (SELECT set_id, id, line_no, CASE WHEN n_chars < 10 THEN 'bad id'
   WHEN (CASE WHEN kind = 'rej' AND n_chars % 3 = 0 THEN 'none' ELSE source END) <> CASE len(list_distinct(gold)) WHEN 0 THEN 'none' WHEN 1 THEN gold[1] ELSE 'many' END
   THEN 'scope differs from gold' END AS problem FROM caseset)"""


@query("M3_bad_ids_scope_mismatch", sql(b.CASESET_SQL, ID_SQL, "SELECT * FROM idp WHERE problem IS NOT NULL"))
def bad_ids(lake: Lake) -> DataFrame:
    return caseset.id_problems(b.caseset(lake))


@query("M4_dup_gold", sql(b.CASESET_SQL, """
SELECT set_id, id, line_no, 'gold repeated' AS problem FROM caseset WHERE len(gold) > len(list_distinct(gold))"""))
def dup_gold(lake: Lake) -> DataFrame:
    return caseset.repeated_gold(b.caseset(lake))


def known_skills(lake: Lake) -> DataFrame:
    return lake.documents.filter("source <> 'src7' AND source <> 'src0'") \
        .select(F.col("source").alias("skill_id")).distinct()


@query("M4_unknown_gold", sql(b.CASESET_SQL, """
SELECT DISTINCT set_id, id, line_no, skill_id FROM (SELECT *, unnest(gold) AS skill_id FROM caseset) x WHERE skill_id IN ('src7', 'src0')"""))
def unknown_gold(lake: Lake) -> DataFrame:
    return caseset.unknown_gold(b.caseset(lake), known_skills(lake))


TYPE_SQL = """
tg AS (SELECT set_id, id, line_no, CASE WHEN kind = 'rej' AND len(gold) > 0 THEN 'rejection case with gold'
   WHEN kind IN ('pos', 'amb') AND len(gold) = 0 THEN 'case without gold'
   WHEN kind = 'multi' AND len(list_distinct(gold)) < 2 THEN 'multi case with fewer than two skills' END AS problem FROM caseset)"""


@query("M5_type_gold_rules", sql(b.CASESET_SQL, TYPE_SQL, "SELECT * FROM tg WHERE problem IS NOT NULL"))
def type_gold_rules(lake: Lake) -> DataFrame:
    return caseset.type_gold_problems(b.caseset(lake))


@query("M6_missing_types", """
SELECT set_id, case_type FROM (SELECT set_id, unnest(['pos', 'amb', 'rej', 'multi']) AS case_type,
  unnest([count(*) FILTER (WHERE doc_id % 4 = 0), count(*) FILTER (WHERE doc_id % 4 = 1), count(*) FILTER (WHERE doc_id % 4 = 3), count(*) FILTER (WHERE doc_id % 4 = 2)]) AS n
  FROM (SELECT lang || source AS set_id, doc_id FROM documents) d GROUP BY 1) x WHERE n = 0""")
def missing_types(lake: Lake) -> DataFrame:
    small = lake.documents.join(
        b.caseset(lake).select("doc_id", "id"), "doc_id").select(F.concat("lang", "source").alias("set_id"), "id")
    return caseset.missing_types(small, ("pos", "amb", "rej", "multi"))


@query("M6_size_limits", """
SELECT s.source AS set_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'empty set' ELSE 'too many cases' END AS problem
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) c
ON s.source = c.source WHERE coalesce(n, 0) = 0 OR n > 2""")
def size_limits(lake: Lake) -> DataFrame:
    sets = lake.documents.select(F.col("source").alias("set_id")).distinct()
    toxic = lake.labels.filter("toxic = 1").join(lake.documents.select("doc_id", "source"), "doc_id") \
        .select(F.col("source").alias("set_id"))
    return caseset.size_problems(sets, toxic, 2)


@query("M7_case_set_issues", sql(b.CASESET_SQL, PROMPT_SQL, ID_SQL, TYPE_SQL, """,
iss AS (
  SELECT set_id, 'duplicate id' AS problem, 1 AS w FROM (SELECT set_id, id FROM caseset GROUP BY 1, 2 HAVING count(*) > 1) a
  UNION ALL SELECT set_id, problem, 1 FROM dp WHERE line_no <> first_line
  UNION ALL SELECT set_id, problem, 1 FROM idp WHERE problem IS NOT NULL
  UNION ALL SELECT set_id, 'gold repeated', 1 FROM caseset WHERE len(gold) > len(list_distinct(gold))
  UNION ALL SELECT set_id, 'unknown gold', 1 FROM (SELECT DISTINCT set_id, id, line_no, skill_id FROM (SELECT *, unnest(gold) AS skill_id FROM caseset) x WHERE skill_id IN ('src7', 'src0')) u
  UNION ALL SELECT set_id, problem, 1 FROM tg WHERE problem IS NOT NULL
  UNION ALL SELECT set_id, 'too many cases', 1 FROM caseset GROUP BY set_id HAVING count(*) > 100)
SELECT set_id, problem, count(*) AS n FROM iss GROUP BY 1, 2"""))
def case_set_issues(lake: Lake) -> DataFrame:
    cases = b.caseset(lake)
    found = caseset.case_set_issues(cases, known_skills(lake), cases.select("set_id").distinct(),
                                    max_cases=100)
    return found.groupBy("set_id", "problem").agg(F.count(F.lit(1)).alias("n"))


MIX_SQL = """
sets AS (SELECT source AS set_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 4),
raw AS (SELECT set_id, n, t.case_type, t.pos, n * t.w AS r, greatest(1, floor(n * t.w)) AS base FROM sets,
   (VALUES ('pos', 0, 0.4e0), ('amb', 1, 0.3e0), ('rej', 2, 0.2e0), ('multi', 3, 0.1e0)) t(case_type, pos, w)),
rk AS (SELECT *, n - sum(base) OVER (PARTITION BY set_id) AS spare, row_number() OVER (PARTITION BY set_id ORDER BY r - floor(r) DESC, pos) AS k FROM raw),
mix AS (SELECT set_id, case_type, CAST(base + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota, CAST(NULL AS VARCHAR) AS problem FROM rk
   UNION ALL SELECT source, NULL, NULL, 'too few cases' FROM documents GROUP BY source HAVING count(*) < 4)"""


def quotas(lake: Lake) -> DataFrame:
    sets = lake.documents.groupBy(F.col("source").alias("set_id")).agg(F.count(F.lit(1)).alias("n_cases"))
    return caseset.expected_mix(sets, with_multi=True)


@query("M8_expected_mix", sql(MIX_SQL, "SELECT * FROM mix"))
def expected_mix(lake: Lake) -> DataFrame:
    return quotas(lake)


@query("M9_mix_check", sql(MIX_SQL, """
SELECT mix.set_id, mix.case_type, quota, CASE WHEN problem IS NULL THEN coalesce(actual, 0) END AS actual, problem FROM mix LEFT JOIN (
  SELECT source AS set_id, CASE doc_id % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'amb' WHEN 2 THEN 'multi' ELSE 'rej' END AS case_type, count(*) AS actual
  FROM documents GROUP BY 1, 2) a ON a.set_id = mix.set_id AND a.case_type = mix.case_type WHERE problem IS NOT NULL OR coalesce(actual, 0) <> quota"""))
def mix_check(lake: Lake) -> DataFrame:
    cases = b.caseset(lake).withColumn("set_id", F.col("source"))
    return caseset.mix_check(cases, quotas(lake))


@query("M10_rationale_coverage", sql(b.CASESET_SQL, """
SELECT DISTINCT set_id, id FROM caseset WHERE kind = 'rej' AND (set_id, id) NOT IN (
  SELECT set_id, id FROM caseset WHERE doc_id IN (SELECT doc_id FROM labels))"""))
def rationale_coverage(lake: Lake) -> DataFrame:
    cases = b.caseset(lake)
    notes = cases.join(lake.labels.select("doc_id"), "doc_id", "left_semi").select("set_id", "id")
    return caseset.rationale_gaps(cases, notes)


@query("M11_metadata_gaps", """
SELECT p_type AS run_id, 'p' || p_partkey AS skill_id, 'target without description' AS problem FROM part WHERE p_size < 5 AND p_retailprice < 1000
UNION ALL SELECT p_type, 'p' || p_partkey, 'disabled skill in catalog' FROM part WHERE p_size = 50""")
def metadata_gaps(lake: Lake) -> DataFrame:
    skill = F.concat(F.lit("p"), "p_partkey").alias("skill_id")
    run = F.col("p_type").alias("run_id")
    catalog = lake.part.select(
        run, skill, F.when(F.col("p_size") >= 5, F.col("p_name")).alias("description"),
        (F.col("p_size") == 50).alias("disabled"))
    targets = lake.part.filter("p_retailprice < 1000").select(run, skill)
    return caseset.metadata_gaps(catalog, targets)


# --- suggestion checks --------------------------------------------------------


@query("L3_validate_clusters", """
SELECT set_id, subject, problem FROM (
  SELECT lang AS set_id, doc_id, n_chars, unnest(['d' || doc_id, 'x' || doc_id]) AS subject,
     unnest([CASE WHEN n_chars % 10 = 0 THEN 'case not covered' WHEN n_chars % 13 = 0 THEN 'quote not in the case''s output' END,
             CASE WHEN n_chars % 17 = 0 THEN 'not a failing case' END]) AS problem FROM documents) x WHERE problem IS NOT NULL
UNION ALL SELECT lang, 'd' || doc_id, 'case in two clusters' FROM documents WHERE n_chars % 10 <> 0 AND n_chars % 7 = 0
UNION ALL SELECT lang, 'd' || doc_id, 'evidence outside its cluster' FROM documents WHERE n_chars % 10 = 0""")
def validate_clusters(lake: Lake) -> DataFrame:
    n, case = F.col("n_chars"), F.concat(F.lit("d"), F.col("doc_id"))
    failures = lake.documents.select(
        F.col("lang").alias("set_id"), case.alias("case_id"), F.col("text").alias("raw_output"),
        F.lit(None).cast("string").alias("failure_detail"))
    named = lake.documents.filter(n % 10 != 0).select(
        F.col("lang").alias("set_id"), F.col("source").alias("cluster_id"), case.alias("case_id"), n.alias("n"))
    again = named.filter("n % 7 = 0").withColumn("cluster_id", F.lit("other"))
    stray = lake.documents.filter(n % 17 == 0).select(
        F.col("lang").alias("set_id"), F.col("source").alias("cluster_id"),
        F.concat(F.lit("x"), "doc_id").alias("case_id"), n.alias("n"))
    clusters = named.unionByName(again).unionByName(stray).drop("n")
    quote = F.when(n % 13 == 0, F.concat(F.substring("text", 1, 20), F.lit("§"))).otherwise(
        F.concat(F.lit("**"), F.substring("text", 1, 20)))
    quotes = lake.documents.select(
        F.col("lang").alias("set_id"), F.col("source").alias("cluster_id"), case.alias("case_id"),
        quote.alias("quote"))
    return evidence.cluster_violations(clusters, quotes, failures)
