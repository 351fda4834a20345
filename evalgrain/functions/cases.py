"""Expressions over case, suite and rubric fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalgrain.functions.text import content_hash

# Fixed values.
FAILURE_TAGS = ("failure", "error", "robustness", "异常", "容错")
CANONICAL_TAG = {
    "pos": "positive", "amb": "ambiguous", "rej": "no-skill", "multi": "multi-skill",
}
CASE_ID_PATTERN = r"^([A-Za-z0-9_.+-]+)-(pos|amb|rej|multi)-(\d{2,})$"
GATE_PATTERN = r"^(>=|<=)\s+(0(?:\.\d+)?|1(?:\.0+)?)$"
SECRET_PATH_PARTS = (
    "api_key", "apikey", "access_token", "token", "secret", "password", "passwd",
    "credential", "authorization", "cookie", "session_key",
)
CONTENT_PATH_SEGMENTS = (
    "body", "content", "document", "input", "input_text", "messages", "payload", "prompt", "text",
)
GOLD_VALUE_LIMIT = 200
SECRET_CONFIG_PARTS = ("api_key", "secret", "password", "access_token", "credential")


def case_stage(stage: Column, tags: Column, has_artifacts: Column, has_logic: Column) -> Column:
    """Declared stage; else failure tags, then artifact claims, then tool claims, then trigger."""
    failure = F.arrays_overlap(
        F.transform(tags, F.lower), F.array(*[F.lit(t) for t in FAILURE_TAGS]))
    return (
        F.when(stage.isNotNull() & (stage != ""), stage)
        .when(F.coalesce(failure, F.lit(False)), F.lit("failure"))
        .when(F.coalesce(has_artifacts, F.lit(False)), F.lit("artifact"))
        .when(F.coalesce(has_logic, F.lit(False)), F.lit("logic"))
        .otherwise(F.lit("trigger"))
    )


def canonical_tags(case_type: Column, tags: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CANONICAL_TAG.items() for x in pair])
    canonical = F.try_element_at(known, case_type)
    return F.when(canonical.isNotNull(), F.array(canonical)).otherwise(tags)


def gate_condition(condition: Column) -> Column:
    """struct(op, threshold); both NULL when the text is no valid condition."""
    valid = condition.rlike(GATE_PATTERN)
    return F.struct(
        F.when(valid, F.regexp_extract(condition, GATE_PATTERN, 1)).alias("op"),
        F.when(valid, F.regexp_extract(condition, GATE_PATTERN, 2).cast("double"))
        .alias("threshold"),
    )


def dimension_applicable(requires: Column, has_reference: Column, has_artifacts: Column) -> Column:
    """A rubric whose input is missing is N/A for the run."""
    return (
        (~F.array_contains(requires, "reference") | has_reference)
        & (~F.array_contains(requires, "artifacts") | has_artifacts)
    )


def catalog_line(skill_id: Column, description: Column, triggers: Column, exclusions: Column) -> Column:
    """One line of the catalog a model is shown."""
    def part(label: str, words: Column) -> Column:
        return F.when(F.size(words) > 0, F.concat(F.lit(label), F.array_join(words, ", "))) \
            .otherwise(F.lit(""))

    return F.trim(F.concat(
        F.lit("- "), skill_id, F.lit(": "), F.coalesce(description, F.lit("")), F.lit(" "),
        part("触发词: ", triggers), F.lit(" "), part("排除: ", exclusions)))


def normalized_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def is_inline_secret_key(name: Column) -> Column:
    """A key that names a secret itself rather than a reference to one."""
    key = normalized_key(name)
    sensitive = F.lit(False)
    for part in SECRET_CONFIG_PARTS:
        sensitive = sensitive | key.contains(part)
    return sensitive & ~key.endswith("_env") & ~key.endswith("_id")


def sorted_map(column: Column) -> Column:
    """A map as JSON text with its keys in order; an absent map is empty."""
    return F.coalesce(
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column)))), F.lit("{}"))


# Suite fields that do not change what a run does.
HASH_EXEMPT = ("suite_id", "suite_version", "description", "models", "parallelism", "skills.target",
               "scoring.judge")


def config_hash(suite: Column, fields: list[str], model: Column, mock: Column, runtime: Column,
                environment: Column, skills: Column, dataset_hash: Column) -> Column:
    """Fingerprint of a run's setup: equal hashes mean comparable runs.

    `fields` are the leaf paths of the suite struct in use; exempt ones are left
    out, and a parallelism of 1 counts as not set.
    """
    kept = sorted(f for f in fields if f not in HASH_EXEMPT and not f.startswith(HASH_EXEMPT))
    parts = [F.to_json(F.struct(*[_leaf(suite, f).alias(f.replace(".", "_")) for f in kept]))]
    if "parallelism" in fields:
        parts.append(F.when(suite["parallelism"] != 1, suite["parallelism"].cast("string")))
    parts += [model, mock.cast("string"), runtime, environment, sorted_map(skills), dataset_hash]
    return content_hash(F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts])))


def _leaf(struct: Column, path: str) -> Column:
    for name in path.split("."):
        struct = struct[name]
    return struct
