"""Quality of a set of cases: duplicates, naming, gold and mix.

Cases: set_id, id, prompt, gold (array), line_no.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from evalgrain.functions.cases import (
    CASE_ID_PATTERN, CONTENT_PATH_SEGMENTS, GOLD_VALUE_LIMIT, SECRET_PATH_PARTS,
    SECRET_CONFIG_PARTS, is_inline_secret_key, normalized_key,
)
from evalgrain.functions.text import case_type, normalize_prompt
from evalgrain.operators import joins, ordered
from evalgrain.session import materialize

# Weights of the case mix, in their declared order.
MIX_WITH_MULTI = (("pos", 0.4), ("amb", 0.3), ("rej", 0.2), ("multi", 0.1))
MIX_SINGLE = (("pos", 0.4), ("amb", 0.3), ("rej", 0.3))


def duplicate_ids(cases: DataFrame) -> DataFrame:
    return joins.duplicate_keys(cases, ["set_id", "id"])


def duplicate_prompts(cases: DataFrame) -> DataFrame:
    """Cases whose normalized prompt occurred before, against the first occurrence.

    Prompts meet by their hash, and the first occurrence is found by an
    aggregate that combines before the shuffle: a prompt copied into a third of
    the rows is never gathered in one place.
    """
    keyed = cases.withColumn("_prompt", F.sha2(normalize_prompt(F.col("prompt")), 256))
    first = ordered.first_of(
        keyed.select("set_id", "_prompt", "line_no", F.col("line_no").alias("first_line"),
                     F.col("id").alias("first_id"), F.col("gold").alias("first_gold")),
        ["set_id", "_prompt"], F.col("line_no"), ["first_line", "first_id", "first_gold"])
    later = keyed.select("set_id", "_prompt", "id", "gold", "line_no") \
        .join(first, ["set_id", "_prompt"]).filter("line_no <> first_line")
    problem = F.when(F.col("gold").eqNullSafe(F.col("first_gold")), "duplicate prompt") \
        .otherwise("same prompt, other gold")
    return later.select("set_id", "id", "line_no", "first_id", problem.alias("problem"))


def id_problems(cases: DataFrame) -> DataFrame:
    """Ids that break the naming rule, and ids whose scope is not their gold."""
    fits = F.col("id").rlike(CASE_ID_PATTERN)
    scope = F.array_sort(F.array_distinct(F.split(F.regexp_extract("id", CASE_ID_PATTERN, 1), r"\+")))
    gold = F.when(F.size("gold") > 0, F.array_sort(F.array_distinct("gold"))) \
        .otherwise(F.array(F.lit("none")))
    problem = F.when(~fits, "bad id").when(scope != gold, "scope differs from gold")
    return cases.select("set_id", "id", "line_no", problem.alias("problem")).filter("problem IS NOT NULL")


def repeated_gold(cases: DataFrame) -> DataFrame:
    return cases.filter(F.size("gold") > F.size(F.array_distinct("gold"))) \
        .select("set_id", "id", "line_no", F.lit("gold repeated").alias("problem"))


def unknown_gold(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """(set_id, id, skill_id) for gold skills the catalog does not hold."""
    gold = cases.select("set_id", "id", "line_no", F.explode("gold").alias("skill_id")).distinct()
    return gold.join(catalog.select("skill_id").distinct(), "skill_id", "left_anti")


def type_gold_problems(cases: DataFrame) -> DataFrame:
    kind = case_type(F.col("id"))
    distinct_gold = F.size(F.array_distinct("gold"))
    problem = (
        F.when((kind == "rej") & (F.size("gold") > 0), "rejection case with gold")
        .when(kind.isin("pos", "amb") & (F.size("gold") == 0), "case without gold")
        .when((kind == "multi") & (distinct_gold < 2), "multi case with fewer than two skills")
    )
    return cases.select("set_id", "id", "line_no", problem.alias("problem")).filter("problem IS NOT NULL")


def missing_types(cases: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(set_id, case_type) for required types a set lacks."""
    kind = case_type(F.col("id"))
    present = cases.groupBy("set_id").agg(*[F.count_if(kind == t).alias(t) for t in required])
    return present.unpivot("set_id", list(required), "case_type", "n").filter("n = 0") \
        .select("set_id", "case_type")


def size_problems(sets: DataFrame, cases: DataFrame, max_cases: int | None = None) -> DataFrame:
    """Empty sets and sets above the limit. `sets`: set_id."""
    counted = sets.select("set_id").join(
        cases.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")), "set_id", "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)))
    too_many = F.col("n") > max_cases if max_cases is not None else F.lit(False)
    return counted.select("set_id", "n", F.when(F.col("n") == 0, "empty set")
                          .when(too_many, "too many cases").alias("problem")) \
        .filter("problem IS NOT NULL")


def case_set_issues(cases: DataFrame, catalog: DataFrame, sets: DataFrame,
                    required: tuple[str, ...] = ("pos", "amb", "rej"),
                    max_cases: int | None = None) -> DataFrame:
    """All issues as (set_id, id, problem, detail), one row each."""
    def shape(df: DataFrame, problem: Column, subject: Column, detail: Column) -> DataFrame:
        return df.select("set_id", subject.cast("string").alias("id"), problem.alias("problem"),
                         detail.cast("string").alias("detail"))

    own, none = F.col("problem"), F.lit(None).cast("string")
    subject = F.col("id")
    return (
        shape(duplicate_ids(cases), F.lit("duplicate id"), subject, F.col("n"))
        .unionByName(shape(duplicate_prompts(cases), own, subject, F.col("first_id")))
        .unionByName(shape(id_problems(cases), own, subject, none))
        .unionByName(shape(repeated_gold(cases), own, subject, none))
        .unionByName(shape(unknown_gold(cases, catalog), F.lit("unknown gold"), subject, F.col("skill_id")))
        .unionByName(shape(type_gold_problems(cases), own, subject, none))
        .unionByName(shape(missing_types(cases, required), F.lit("missing type"), none, F.col("case_type")))
        .unionByName(shape(size_problems(sets, cases, max_cases), own, none, F.col("n")))
    )


def expected_mix(sets: DataFrame, with_multi: bool) -> DataFrame:
    """Exact quota per type by largest remainder, at least one each; ties in declared order.

    `sets`: set_id, n_cases. A set with fewer cases than types has no mix: one
    row without type and quota names the problem. The window holds the three or four types of a set.
    """
    weights = MIX_WITH_MULTI if with_multi else MIX_SINGLE
    types = F.posexplode(F.array(*[
        F.struct(F.lit(t).alias("case_type"), F.lit(w).alias("weight")) for t, w in weights]))
    rows = sets.filter(F.col("n_cases") >= len(weights)) \
        .select("set_id", "n_cases", types.alias("_pos", "_t")) \
        .select("set_id", "n_cases", "_pos", "_t.*") \
        .withColumn("_raw", F.col("n_cases") * F.col("weight")) \
        .withColumn("_base", F.greatest(F.lit(1), F.floor("_raw")))
    whole = Window.partitionBy("set_id")
    by_fraction = whole.orderBy(F.desc(F.col("_raw") % 1), "_pos")
    spare = F.col("n_cases") - F.sum("_base").over(whole)
    none = F.lit(None).cast("string")
    mix = rows.withColumn("_spare", spare).withColumn("_rank", F.row_number().over(by_fraction)) \
        .select("set_id", "case_type", (F.col("_base") + F.when(
            F.col("_rank") <= F.col("_spare"), 1).otherwise(0)).cast("bigint").alias("quota"),
            none.alias("problem"))
    small = sets.filter(F.col("n_cases") < len(weights)).select(
        "set_id", none.alias("case_type"), F.lit(None).cast("bigint").alias("quota"),
        F.lit("too few cases").alias("problem"))
    return mix.unionByName(small)


def mix_check(cases: DataFrame, quota: DataFrame) -> DataFrame:
    """Types whose count is not their quota, and sets too small for a mix."""
    actual = cases.groupBy("set_id", case_type(F.col("id")).alias("case_type")) \
        .agg(F.count(F.lit(1)).alias("actual"))
    return quota.join(actual, ["set_id", "case_type"], "left") \
        .withColumn("actual", F.when(F.col("problem").isNull(), F.coalesce("actual", F.lit(0)))) \
        .filter("problem IS NOT NULL OR actual <> quota")


def rationale_gaps(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """No-skill cases nobody explained. `notes`: set_id, id."""
    return cases.filter(case_type(F.col("id")) == "rej").select("set_id", "id").distinct() \
        .join(notes.select("set_id", "id"), ["set_id", "id"], "left_anti")


def metadata_gaps(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """Target skills without a description, and disabled skills still shown.

    `catalog`: run_id, skill_id, description, disabled. `targets`: run_id, skill_id.
    """
    bare = catalog.filter(F.coalesce("description", F.lit("")) == "") \
        .join(targets, ["run_id", "skill_id"], "left_semi") \
        .select("run_id", "skill_id", F.lit("target without description").alias("problem"))
    off = catalog.filter("disabled").select(
        "run_id", "skill_id", F.lit("disabled skill in catalog").alias("problem"))
    return bare.unionByName(off)


def expectation_problems(assertions: DataFrame) -> DataFrame:
    """Argument assertions that may not be used.

    Input: keys, assertion_index, tool, path, required, forbidden, equals
    (variant), in_values (array of variant), matches.
    """
    given = [F.coalesce("required", F.lit(False)), F.coalesce("forbidden", F.lit(False)),
             F.col("equals").isNotNull(), F.col("in_values").isNotNull(), F.col("matches").isNotNull()]
    count = sum((g.cast("int") for g in given[1:]), given[0].cast("int"))
    path = normalized_key(F.col("path"))
    secret = F.lit(False)
    for part in SECRET_PATH_PARTS:
        secret = secret | path.contains(part)
    content = F.arrays_overlap(
        F.split(path, r"\."), F.array(*[F.lit(s) for s in CONTENT_PATH_SEGMENTS]))
    stored = F.col("equals").isNotNull() | F.col("in_values").isNotNull() | F.col("matches").isNotNull()
    too_long = (F.length(F.to_json("equals")) > GOLD_VALUE_LIMIT) \
        | (F.length("matches") > GOLD_VALUE_LIMIT) \
        | F.exists("in_values", lambda v: F.length(F.to_json(v)) > GOLD_VALUE_LIMIT)
    listed = F.size("in_values")
    checks = [
        (F.coalesce(F.col("tool") == "", F.lit(True)), "no tool"),
        (~F.coalesce(F.col("path").rlike(r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*$"), F.lit(False)),
         "bad path"),
        (count != 1, "not exactly one matcher"),
        (secret, "secret path"),
        (stored & content, "content value stored"),
        (F.coalesce(too_long, F.lit(False)), "gold value too long"),
        (F.col("in_values").isNotNull() & ~listed.between(1, 50), "value list size"),
        (F.col("matches").isNotNull() & F.coalesce(F.length("matches") == 0, F.lit(False)),
         "empty regex"),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    return assertions.withColumn("problem", F.explode(problems))


@F.pandas_udf(BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    def check(pattern) -> bool | None:
        if pattern is None:
            return None
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True

    return patterns.map(check)


def regex_problems(assertions: DataFrame) -> DataFrame:
    """Assertions whose regex does not compile. Each distinct regex is tried once."""
    broken = assertions.filter("matches IS NOT NULL").select("matches").distinct() \
        .filter(~_compiles(F.col("matches")))
    return assertions.join(broken, "matches", "left_semi") \
        .withColumn("problem", F.lit("regex does not compile"))


def repeated_assertions(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """Argument assertions declared more than once for the same turn."""
    rule = F.to_json(F.struct("tool", "path", "required", "forbidden", "equals", "in_values", "matches"))
    return joins.duplicate_keys(assertions.withColumn("rule", rule), [*keys, "rule"]) \
        .select(*keys, F.lit("assertion repeated").alias("problem"))


def tool_list_problems(expectations: DataFrame) -> DataFrame:
    """Contradictions in the tool lists of a trajectory expectation."""
    def repeated(column: str) -> Column:
        return F.coalesce(F.size(column) > F.size(F.array_distinct(column)), F.lit(False))

    overlap = F.coalesce(F.size(F.array_intersect("required_tools", "forbidden_tools")) > 0, F.lit(False))
    unprobed = F.coalesce("required_verification", F.lit(False)) \
        & (F.coalesce(F.size("verification_tools"), F.lit(0)) <= 0)
    checks = [
        (repeated("required_tools"), "required_tools repeated"),
        (repeated("forbidden_tools"), "forbidden_tools repeated"),
        (repeated("verification_tools"), "verification_tools repeated"),
        (overlap, "required and forbidden overlap"),
        (unprobed, "verification without probe tools"),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    return expectations.withColumn("problem", F.explode(problems))


def inline_secrets(configs: DataFrame) -> DataFrame:
    """Paths of configuration keys that hold a secret instead of naming one, at any depth.

    Input: config_id, config (VARIANT). Only documents with a suspicious key are
    opened, one level of nesting per round. A level is written to the shared
    folder, so rounds end when nothing is left to open and lineage stays short.
    """
    spark = configs.sparkSession
    suspicious = normalized_key(F.to_json("config")).rlike("|".join(SECRET_CONFIG_PARTS))
    level = configs.filter(suspicious).select(
        "config_id", F.lit("suite").alias("path"), F.to_json("config").alias("node"))
    found = None
    while True:
        opened = spark.sql(
            "SELECT t.config_id, t.path, v.pos, v.key, v.value FROM {level} t, "
            "LATERAL variant_explode(parse_json(t.node)) v", level=level)
        child = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")) \
            .otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        secret = F.coalesce(is_inline_secret_key(F.col("key")), F.lit(False))
        named = materialize(opened.select(
            "config_id", child.alias("path"), secret.alias("secret"), F.to_json("value").alias("node"))
            .filter(F.col("secret") | F.col("node").rlike(r"^[\[{]")), "config_level")
        hits = named.filter("secret").select("config_id", "path", F.lit("inline secret").alias("problem"))
        found = hits if found is None else found.unionByName(hits)
        level = named.filter("NOT secret").select("config_id", "path", "node")
        if level.isEmpty():
            return found
