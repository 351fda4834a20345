"""Joins, set comparisons and expansions.

No side is broadcast by hint: Spark broadcasts a side only when its measured
size is under the session's threshold, and splits skewed partitions of the
larger side at run time. Sides that must be unique per key are reduced to one
row per key first, so a hot key is never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import cases, files, text
from evalgrain.operators import ordered

CONVERSATION = ["run_id", "case_id", "repeat_index"]
RUN_KEY = [*CONVERSATION, "turn_index"]


def resolve_turns(case_rows: DataFrame) -> DataFrame:
    """One row per case turn: the case's own fields are turn 1, `turns[i]` is turn i + 2."""
    turn_type = case_rows.schema["turns"].dataType.elementType
    head = F.struct(*[
        (F.coalesce(F.col(f.name), F.lit(False)) if f.dataType.simpleString() == "boolean"
         else F.col(f.name)).alias(f.name)
        for f in turn_type
    ]).cast(turn_type)
    rest = F.coalesce(F.col("turns"), F.array().cast(case_rows.schema["turns"].dataType))
    shared = [c for c in case_rows.columns if c not in {"turns", *turn_type.names}]
    return case_rows.select(
        *shared, F.posexplode(F.concat(F.array(head), rest)).alias("_pos", "_turn"),
    ).select(
        *shared, (F.col("_pos") + 1).alias("turn_index"),
        *[F.col(f"_turn.{name}").alias(name) for name in turn_type.names])


def build_matrix(
    case_rows: DataFrame, models: list[str], repeats: int, suite_id: str, execution_id: str,
    session_prefix: str = "eval", turn_count: Column | None = None,
) -> DataFrame:
    """model × case × repeat × turn with stable ids; no shuffle, no join.

    Models and repeats are suite settings of known length, so they fan out each
    case row where it is read.
    """
    names = [m for m in models if m]
    if not suite_id.strip() or not execution_id.strip():
        raise ValueError("suite_id and execution_id must not be empty")
    if repeats < 1:
        raise ValueError(f"repeats must be at least 1, got {repeats}")
    if not models or len(names) != len(models) or len(set(names)) != len(names):
        raise ValueError("models must be non-empty, named and unique")
    suite, execution = text.slug(F.lit(suite_id)), text.slug(F.lit(execution_id))
    axis = F.array(*[
        F.struct(F.lit(m).alias("model_id"), text.slug(F.lit(m)).alias("slug"), F.lit(i).alias("model_order"))
        for i, m in enumerate(models)])
    turns = turn_count if turn_count is not None else F.lit(1)
    tasks = (
        case_rows.select("case_id", text.slug(F.col("case_id")).alias("_case"),
                         turns.cast("int").alias("_turns"))
        .withColumn("_model", F.explode(axis))
        .withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("turn_index", F.explode(F.sequence(F.lit(1), F.col("_turns"))))
    )
    model, repeat = F.col("_model.slug"), F.concat(F.lit("r"), F.col("repeat_index"))
    return tasks.select(
        F.lit(suite_id).alias("suite_id"), F.lit(execution_id).alias("execution_id"),
        "_model.model_id", "case_id", "repeat_index", "turn_index",
        F.concat_ws(".", suite, model, "_case", F.concat(F.lit("t"), F.col("turn_index")), repeat)
        .alias("request_id"),
        F.concat_ws(".", F.lit(session_prefix), execution, suite, model, "_case", repeat)
        .alias("session_id"),
        "_model.model_order",
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def case_key(runs: DataFrame, cases: DataFrame, key: list[str]) -> list[str]:
    """The key of runs and cases: versions of a dataset share case ids, so `dataset_hash` belongs to it.

    Tables without it hold one dataset; one table with and one without it cannot be joined.
    """
    named = ["dataset_hash" in table.columns for table in (runs, cases)]
    if any(named) and not all(named):
        raise ValueError("runs and cases must both carry dataset_hash, or neither")
    return ["dataset_hash", *key] if all(named) else key


def with_dataset(runs: DataFrame, run_dim: DataFrame) -> DataFrame:
    """Runs with the dataset their snapshot names."""
    return runs.join(run_dim.select("run_id", "dataset_hash"), "run_id", "left")


def runs_with_case(runs: DataFrame, turns: DataFrame, on: list[str] | None = None) -> DataFrame:
    return runs.join(turns, on or case_key(runs, turns, ["case_id", "turn_index"]))


def orphan_runs(runs: DataFrame, turns: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Runs whose case or turn does not exist: an error of the log, reported as rows."""
    keys = on or case_key(runs, turns, ["case_id", "turn_index"])
    return runs.join(turns.select(*keys), keys, "left_anti")


def runs_with_grading(runs: DataFrame, gradings: DataFrame) -> DataFrame:
    """Each run turn with the grading of the judge chosen for its run, if any."""
    return runs.join(gradings, RUN_KEY, "left")


def system_conversations(turns: DataFrame) -> DataFrame:
    return turns.filter(F.col("error_kind").isin(*text.SYSTEM_KINDS)) \
        .select(*CONVERSATION).distinct()


def drop_system_conversations(turns: DataFrame) -> DataFrame:
    """Leave out every conversation in which some turn failed for infrastructure reasons."""
    return turns.join(system_conversations(turns), CONVERSATION, "left_anti")


def evaluable_routing_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(F.coalesce(F.col("ok"), F.lit(True)))


def coverage(
    expected: DataFrame, actual: DataFrame, keys: list[str], excused: DataFrame | None = None,
    excuse_keys: list[str] | None = None,
) -> DataFrame:
    """Keys found on one side only, as rows (keys, problem).

    A missing key is excused when the judge call that should have produced it
    failed.
    """
    missing = expected.select(*keys).distinct().join(actual.select(*keys), keys, "left_anti")
    if excused is not None:
        on = excuse_keys or keys
        missing = missing.join(excused.select(*on), on, "left_anti")
    unexpected = actual.select(*keys).distinct().join(expected.select(*keys), keys, "left_anti")
    return missing.withColumn("problem", F.lit("missing")).unionByName(
        unexpected.withColumn("problem", F.lit("unexpected")))


def diff_case_sets(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases added, missing or changed between two sets; gold is compared in order.

    Both sides carry id, prompt, gold (array), line_no; of repeated ids the last
    line counts.
    """
    left = ordered.last_of(reference, ["id"], F.col("line_no"), ["prompt", "gold"]).select(
        "id", F.col("prompt").alias("_p1"), F.col("gold").alias("reference_gold"),
        F.lit(True).alias("_in1"))
    right = ordered.last_of(candidate, ["id"], F.col("line_no"), ["prompt", "gold"]).select(
        "id", F.col("prompt").alias("_p2"), F.col("gold").alias("candidate_gold"),
        F.lit(True).alias("_in2"))
    prompt_changed = ~F.col("_p1").eqNullSafe(F.col("_p2"))
    gold_changed = ~F.col("reference_gold").eqNullSafe(F.col("candidate_gold"))
    kind = (
        F.when(F.col("_in1").isNull(), "added")
        .when(F.col("_in2").isNull(), "missing")
        .when(prompt_changed & gold_changed, "prompt+gold")
        .when(prompt_changed, "prompt")
        .when(gold_changed, "gold")
    )
    return left.join(right, "id", "full_outer").withColumn("kind", kind) \
        .filter("kind IS NOT NULL") \
        .select(F.col("id").alias("case_id"), "kind", "reference_gold", "candidate_gold")


def artifact_diff(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Files a run created or modified. Snapshots hold path, mtime, size_bytes (and keys)."""
    on = [*(keys or []), "path"]
    old = before.select(*on, F.struct("mtime", "size_bytes").alias("_old"))
    kept = after.filter(~files.is_runtime_state(F.col("path")))
    changed = kept.join(old, on, "left") \
        .filter(~F.col("_old").eqNullSafe(F.struct("mtime", "size_bytes")))
    return changed.select(
        *on, "size_bytes", files.guess_mime(F.col("path")).alias("mime_type"),
        F.when(F.col("_old").isNull(), "created").otherwise("modified").alias("change"))


def workspace_files(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Files present at the end of each turn, one row per path."""
    return manifest.filter(~files.is_runtime_state(F.col("path"), bootstrap=())) \
        .select(*keys, "path").distinct()


def resolve_catalog(
    runs: DataFrame, skills: DataFrame, pins: DataFrame, include: DataFrame, exclude: DataFrame,
) -> DataFrame:
    """Per run, the skill versions a model is shown.

    `runs`: run_id, root, mode. `skills`: root, skill_id, version and content
    columns. `pins`: run_id, skill_id, version. `include` and `exclude`: run_id,
    skill_id; a run without include rows sees its whole root. An unpinned skill
    takes its smallest version; mode `none` shows nothing.
    """
    smallest = ordered.first_of(
        skills, ["root", "skill_id"], text.version_order(F.col("version")), ["version"])
    picked = include.select("run_id", "skill_id", F.lit(True).alias("_picked")).distinct()
    restricted = include.select("run_id", F.lit(True).alias("_restricted")).distinct()
    visible = (
        runs.filter("mode <> 'none'").select("run_id", "root").join(smallest, "root")
        .join(restricted, "run_id", "left").join(picked, ["run_id", "skill_id"], "left")
        .filter("_restricted IS NULL OR _picked")
        .join(exclude.select("run_id", "skill_id"), ["run_id", "skill_id"], "left_anti")
    )
    versions = visible.join(
        pins.select("run_id", "skill_id", F.col("version").alias("_pinned")),
        ["run_id", "skill_id"], "left",
    ).select("run_id", "root", "skill_id", F.coalesce("_pinned", "version").alias("version"))
    return versions.join(skills, ["root", "skill_id", "version"])


def catalog_violations(
    runs: DataFrame, skills: DataFrame, pins: DataFrame, include: DataFrame, exclude: DataFrame,
) -> DataFrame:
    """Settings that name a skill or version the catalog does not hold, or name it twice."""
    known = skills.select("root", "skill_id").distinct()
    roots = runs.select("run_id", "root")

    def unknown(df: DataFrame, problem: str) -> DataFrame:
        return df.select("run_id", "skill_id").distinct().join(roots, "run_id") \
            .join(known, ["root", "skill_id"], "left_anti") \
            .select("run_id", "skill_id", F.lit(problem).alias("problem"))

    no_version = pins.join(roots, "run_id").join(known, ["root", "skill_id"], "left_semi") \
        .join(skills.select("root", "skill_id", "version"),
              ["root", "skill_id", "version"], "left_anti") \
        .select("run_id", "skill_id", F.lit("unknown version").alias("problem"))
    twice = duplicate_keys(include, ["run_id", "skill_id"]) \
        .select("run_id", "skill_id", F.lit("included twice").alias("problem"))
    return (
        unknown(pins, "unknown pinned skill")
        .unionByName(unknown(include, "unknown included skill"))
        .unionByName(unknown(exclude, "unknown excluded skill"))
        .unionByName(no_version).unionByName(twice)
    )


def catalog_text(skills: DataFrame, keys: list[str]) -> DataFrame:
    """The catalog a model is shown, one line per skill in id order.

    The text goes into one prompt, which bounds what a key may hold.
    """
    line = cases.catalog_line(
        F.col("skill_id"), F.col("description"), F.col("triggers"), F.col("exclusions"))
    rows = F.array_sort(F.collect_list(F.struct("skill_id", line.alias("line"))))
    return skills.groupBy(*keys).agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("catalog"))


def unreachable_gold(gold: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Cases that expect a skill nobody is shown. `gold`: one row per (case, skill)."""
    return gold.join(catalog.select(*keys, "skill_id"), [*keys, "skill_id"], "left_anti").distinct()


def version_drift(history: DataFrame, current: DataFrame) -> DataFrame:
    """A version label that stood for other content in an earlier run.

    Both sides: root, skill_id, version (NULL means v1), content_hash; history
    also run_id.
    """
    key = ["root", "skill_id", "version"]

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("version", F.coalesce(text.non_empty(F.col("version")), F.lit("v1")))

    old = labelled(history).filter("content_hash IS NOT NULL AND content_hash <> ''") \
        .groupBy(*key, F.col("content_hash").alias("old_hash")) \
        .agg(F.count_distinct("run_id").alias("runs"), F.min("run_id").alias("first_run"))
    new = labelled(current).select(*key, F.col("content_hash").alias("new_hash"))
    return old.join(new, key).filter("old_hash <> new_hash")


def propagate_owners(dataset_owners: DataFrame, references: DataFrame, explicit: DataFrame) -> DataFrame:
    """Owners of everything a dataset leads to.

    `dataset_owners`: dataset, owner. `references`: dataset, path, category
    (fixture, expected, suite, run). `explicit`: path, owner. Owners named by a
    resource itself replace the ones its datasets would pass on.
    """
    # What names its own owners leaves before references are multiplied by the owners of their datasets.
    derived = references.select("dataset", "path").join(explicit.select("path"), "path", "left_anti") \
        .join(dataset_owners, "dataset").select("path", "owner")
    own = dataset_owners.select(F.col("dataset").alias("path"), "owner")
    return derived.unionByName(own).unionByName(explicit.select("path", "owner")).distinct()


def retention_plan(
    owners: DataFrame, selected: DataFrame, tracked: DataFrame,
    associations: DataFrame | None = None,
) -> DataFrame:
    """What to do with each resource of the selected subjects.

    An association with a selected subject (`associations`: path, owner; else
    ownership itself) puts a path in the plan; it may be removed only when it
    has owners and all of them are selected. Tracked paths stay.
    """
    marked = owners.join(selected.select("owner", F.lit(True).alias("_sel")), "owner", "left")
    per_path = marked.groupBy("path").agg(
        F.count(F.lit(1)).alias("owners"), F.count("_sel").alias("selected_owners"))
    if associations is None:
        planned = per_path.filter("selected_owners > 0")
    else:
        included = associations.join(selected.select("owner"), "owner", "left_semi") \
            .select("path").distinct()
        planned = included.join(per_path, "path", "left")
    action = (
        F.when(F.col("_tracked"), "retain_tracked")
        .when((F.col("owners") > 0) & (F.col("owners") == F.col("selected_owners")),
              "remove_after_verify")
        .otherwise("retain_shared")
    )
    marks = tracked.select("path", F.lit(True).alias("_tracked")).distinct()
    return planned.join(marks, "path", "left").select(
        "path", F.coalesce("owners", F.lit(0)).alias("owners"),
        F.coalesce("selected_owners", F.lit(0)).alias("selected_owners"), action.alias("action"))


def missing_inputs(declared: DataFrame, manifest: DataFrame) -> DataFrame:
    """Declared input files that are not there. `declared`: case_id, path."""
    return declared.join(manifest.select("path"), "path", "left_anti").select("case_id", "path")


def restore_plan(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Per archived path: restore it, reuse the equal file, or report a collision."""
    there = current.select("path", F.col("sha256").alias("_now"), F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_there").isNull(), "restore")
        .when(F.col("sha256").eqNullSafe(F.col("_now")), "reuse")
        .otherwise("collision")
    )
    return manifest.join(there, "path", "left").select("path", "sha256", status.alias("status"))
