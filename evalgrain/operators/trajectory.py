"""Trajectory scoring over flat event rows.

`keys` names the columns of one run turn. `events` has the keys plus the event
columns; `expectations` has the keys plus required_tools, forbidden_tools,
required_order, required_state_change, required_verification,
verification_tools. Event rows are combined per run turn before any shuffle; a
run turn of any length is never collected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions import arguments as args
from evalgrain.schemas import EVENT, TRAJECTORY_METRICS

ORDER_BLOCK = 4096


def explode_events(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.select(*keys, F.explode("trajectory").alias("_e")).select(*keys, "_e.*")


def exact_calls(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'tool_call' AND evidence_level = 'exact'")


def turn_facts(events: DataFrame, keys: list[str]) -> DataFrame:
    """What one pass over the events says about each run turn."""
    def seen(condition: str) -> Column:
        return F.coalesce(F.bool_or(F.expr(condition)), F.lit(False))

    return events.groupBy(*keys).agg(
        F.count_if(F.expr("event_type = 'tool_call' AND evidence_level = 'exact'")).alias("exact_calls"),
        seen("event_type = 'state_change' AND status = 'success'").alias("state_changed"),
        seen("event_type = 'verification' AND status = 'success'").alias("verified"),
        seen("evidence_level = 'exact'").alias("has_exact"))


def observed_tools(events: DataFrame, keys: list[str], summary: DataFrame | None = None) -> DataFrame:
    """(keys, tool) seen in call or result events or in the runtime's tool summary."""
    seen = events.filter(
        "event_type IN ('tool_call', 'tool_result') AND tool_name IS NOT NULL AND tool_name <> ''"
    ).select(*keys, F.col("tool_name").alias("tool"))
    if summary is not None:
        seen = seen.unionByName(summary.filter("name <> ''").select(*keys, F.col("name").alias("tool")))
    return seen.distinct()


def tool_selection(expectations: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Share of required tools used and forbidden tools avoided; NULL when neither is declared."""
    def wanted(column: str, good: bool) -> Column:
        tools = F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))
        return F.transform(tools, lambda t: F.struct(t.alias("tool"), F.lit(good).alias("good")))

    asked = expectations.select(
        *keys, F.explode_outer(F.concat(
            wanted("required_tools", True), wanted("forbidden_tools", False))).alias("_w")
    ).select(*keys, "_w.tool", "_w.good")
    used = asked.join(
        observed.select(*keys, "tool", F.lit(True).alias("_used")), [*keys, "tool"], "left")
    met = F.when(F.col("tool").isNotNull(), (F.col("good") == F.coalesce("_used", F.lit(False)))
                 .cast("double"))
    return used.groupBy(*keys).agg(F.avg(met).alias("tool_selection"))


def argument_scores(events: DataFrame, assertions: DataFrame, keys: list[str],
                    facts: DataFrame | None = None) -> DataFrame:
    """One row per assertion of each run turn: score 1, 0 or NULL, status and counts.

    `assertions`: keys, assertion_index, tool, path, matcher (required,
    forbidden, equals, in, matches), equals, in_values, matches. Calls meet
    their assertions in an inner join, whose larger side can be split when one
    run turn holds most calls; assertions nobody met come back afterwards.
    Patterns are searched for by the same engine that `regex_problems` compiles
    them with; a broken one is never met.
    """
    calls = exact_calls(events).select(
        *keys, F.col("tool_name").alias("tool"),
        args.as_object(F.col("arguments")).alias("_arguments"))
    per_call = calls.join(assertions, [*keys, "tool"]) \
        .withColumn("_value", args.argument_value(F.col("_arguments"), F.col("path")))
    value = F.col("_value")
    tested = (F.col("matcher") == "matches") & (args.value_kind(value) == "STRING")
    per_call = per_call.withColumn("_found", args.regex_found(
        F.when(tested, F.try_variant_get(value, "$", "string")), F.when(tested, F.col("matches"))))
    complete = value.isNotNull() & ~args.value_incomplete(value)
    meets = (
        F.when(F.col("matcher") == "equals", args.json_equal(value, F.col("equals")))
        .when(F.col("matcher") == "in", F.exists(
            "in_values", lambda allowed: args.json_equal(F.col("_value"), allowed)))
        .when(F.col("matcher") == "matches", F.col("_found"))
    )
    judged = per_call.groupBy(*keys, "assertion_index").agg(
        F.count(F.lit(1)).alias("relevant_calls"),
        F.count_if(F.col("_arguments").isNull()).alias("unknown_calls"),
        F.coalesce(F.bool_or(value.isNotNull()), F.lit(False)).alias("present"),
        F.coalesce(F.bool_or(value.isNotNull() & ~complete), F.lit(False)).alias("incomplete"),
        F.coalesce(F.bool_or(complete & meets), F.lit(False)).alias("met"))
    any_exact = (turn_facts(events, keys) if facts is None else facts) \
        .filter("exact_calls > 0").select(*keys, "exact_calls")
    unknown = F.col("unknown_calls") > 0
    no_score = F.lit(None).cast("double")
    score = (
        F.when(F.col("exact_calls").isNull(), no_score)
        .when(F.col("relevant_calls") == 0, 0.0)
        .when((F.col("matcher") == "required") & F.col("present"), 1.0)
        .when((F.col("matcher") == "forbidden") & F.col("present"), 0.0)
        .when(F.col("matcher").isin("required", "forbidden") & unknown, no_score)
        .when(F.col("matcher") == "required", 0.0)
        .when(F.col("matcher") == "forbidden", 1.0)
        .when(F.col("met"), 1.0)
        .when(unknown | F.col("incomplete"), no_score)
        .otherwise(0.0)
    )
    asked = assertions.select(*keys, "assertion_index", "tool", "matcher")
    scored = asked.join(judged, [*keys, "assertion_index"], "left").join(any_exact, keys, "left") \
        .withColumn("relevant_calls", F.coalesce("relevant_calls", F.lit(0))) \
        .withColumn("score", score)
    status = F.when(F.col("score") == 1, "passed").when(F.col("score") == 0, "failed") \
        .otherwise("insufficient_evidence")
    return scored.select(
        *keys, "assertion_index", "tool", "matcher", "relevant_calls", "score",
        status.alias("status"))


def argument_correctness(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg("score").alias("argument_correctness"))


def argument_evidence(events: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Calls an assertion was judged on, as rows: those of its tool, else every exact call."""
    calls = exact_calls(events).select(*keys, F.col("tool_name").alias("tool"), "step_index", "call_id")
    asked = scored.select(*keys, "assertion_index", "tool", "relevant_calls")
    own = asked.filter("relevant_calls > 0").join(calls, [*keys, "tool"])
    others = asked.filter("relevant_calls = 0").drop("tool").join(calls, keys)
    columns = [*keys, "assertion_index", "step_index", "call_id"]
    return own.select(*columns).unionByName(others.select(*columns)).distinct()


def order_correctness(events: DataFrame, expectations: DataFrame, keys: list[str],
                      block: int = ORDER_BLOCK) -> DataFrame:
    """Length of the required order found as a subsequence of exact calls, as a share.

    Walking a stretch of calls maps the number of tools matched before it to
    the number matched after it. Each block of steps is reduced to that map
    where it lies, and the maps of a run turn are then applied one after
    another, so no task sees more than a block of calls.
    """
    asked = expectations.filter(F.size("required_order") > 0).select(*keys, "required_order")
    calls = exact_calls(events).select(*keys, "step_index", F.col("tool_name").alias("tool")) \
        .join(asked, keys)
    wanted = F.when(F.array_contains("required_order", F.col("tool")),
                    F.struct("step_index", "tool"))
    blocks = calls.groupBy(*keys, F.floor(F.col("step_index") / block).alias("_block")).agg(
        F.array_sort(F.collect_list(wanted)).alias("_calls"),
        F.any_value("required_order").alias("required_order"))

    def advance(matched: Column, call: Column) -> Column:
        following = F.try_element_at(F.col("required_order"), matched + 1)
        return F.when(following == call["tool"], matched + 1).otherwise(matched)

    moves = F.transform(
        F.sequence(F.lit(0), F.size("required_order")),
        lambda start: F.aggregate("_calls", start, advance))
    per_turn = blocks.select(*keys, "_block", moves.alias("_moves"), "required_order") \
        .groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("_block", "_moves"))).alias("_blocks"),
            F.any_value("required_order").alias("required_order"))
    matched = F.aggregate(
        "_blocks", F.lit(0), lambda acc, b: F.element_at(b["_moves"], acc + 1))
    return per_turn.select(
        *keys, (matched.cast("double") / F.size("required_order")).alias("order_correctness"))


def state_persistence(expectations: DataFrame, events: DataFrame, artifacts: DataFrame,
                      keys: list[str]) -> DataFrame:
    """1 when a required state change left an artifact or a successful event, else 0."""
    proof = events.filter("event_type = 'state_change' AND status = 'success'").select(*keys) \
        .unionByName(artifacts.select(*keys)).distinct().withColumn("_proof", F.lit(1.0))
    return expectations.filter("required_state_change").select(*keys).join(proof, keys, "left") \
        .select(*keys, F.coalesce("_proof", F.lit(0.0)).alias("state_persistence"))


def argument_strings(arguments: Column) -> Column:
    """Every string value of the arguments, at any depth."""
    strings = F.regexp_extract_all(
        F.to_json(arguments), F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+":?'), F.lit(0))
    values = F.filter(strings, lambda s: ~s.endswith(":"))
    return F.from_json(
        F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")


def readback_rate(expectations: DataFrame, events: DataFrame, artifacts: DataFrame,
                  keys: list[str]) -> DataFrame:
    """Share of written artifacts that a declared probe tool later read successfully.

    A call targets a path when one of its argument strings ends with it. The
    endings of an argument are cut only at lengths that occur among the paths
    of its run turn, and are matched by equality.
    """
    probes = expectations.filter(F.size("verification_tools") > 0) \
        .select(*keys, "verification_tools")
    paths = artifacts.filter("path <> ''").select(*keys, "path").distinct() \
        .join(probes.select(*keys), keys, "left_semi")
    lengths = paths.select(*keys, F.length("path").alias("_length")).distinct()
    endings = (
        exact_calls(events)
        .select(*keys, "step_index", F.col("tool_name").alias("tool"), "call_id",
                F.explode(F.array_distinct(argument_strings(F.col("arguments")))).alias("_text"))
        .join(lengths, keys).filter(F.length("_text") >= F.col("_length"))
        .select(*keys, "step_index", "tool", "call_id",
                F.right(F.col("_text"), F.col("_length")).alias("path"))
    )
    hits = endings.join(paths, [*keys, "path"], "left_semi").join(probes, keys)
    succeeded = events.filter(
        "event_type = 'tool_result' AND status = 'success' AND call_id <> ''"
    ).select(*keys, "call_id", F.lit(True).alias("_ok")).distinct()
    is_probe = F.array_contains("verification_tools", F.col("tool"))
    per_path = hits.join(succeeded, [*keys, "call_id"], "left").groupBy(*keys, "path").agg(
        F.min(F.when(~is_probe, F.col("step_index"))).alias("_written"),
        F.max(F.when(is_probe & F.col("_ok"), F.col("step_index"))).alias("_read"))
    return per_path.filter("_written IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("produced"),
        F.count_if(F.col("_read") > F.col("_written")).alias("verified"),
        F.avg(F.coalesce(F.col("_read") > F.col("_written"), F.lit(False)).cast("double"))
        .alias("readback_rate"))


def verification_rate(expectations: DataFrame, events: DataFrame, artifacts: DataFrame,
                      keys: list[str]) -> DataFrame:
    """1 when the runtime reports a successful verification, else the read-back rate."""
    asked = expectations.filter("required_verification")
    reported = events.filter("event_type = 'verification' AND status = 'success'") \
        .select(*keys, F.lit(1.0).alias("_reported")).distinct()
    readback = readback_rate(asked, events, artifacts, keys).select(*keys, "readback_rate")
    return asked.select(*keys).join(reported, keys, "left").join(readback, keys, "left") \
        .select(*keys, F.coalesce("_reported", "readback_rate").alias("verification_rate"))


def evidence_level(run_keys: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """exact, coarse or missing: the best evidence a run turn left."""
    levels = events.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("evidence_level") == "exact"), F.lit(False)).alias("_exact"))
    level = F.when(F.col("_exact"), "exact").when(~F.col("_exact"), "coarse").otherwise("missing")
    return run_keys.select(*keys).join(levels, keys, "left").select(*keys, level.alias("evidence_level"))


def score_structured(
    run_keys: DataFrame, expectations: DataFrame, events: DataFrame, assertions: DataFrame,
    artifacts: DataFrame, keys: list[str], summary: DataFrame | None = None,
) -> DataFrame:
    """All five deterministic dimensions per run turn; NULL where nothing can be proven.

    What a single pass over the events can say comes from `turn_facts`. The
    dimensions are stacked and brought together by one aggregation, not by a
    join each.
    """
    facts = turn_facts(events, keys)
    arguments = argument_scores(events, assertions, keys, facts)
    asked = expectations.select(*keys, "required_state_change", "required_verification")
    readback = readback_rate(expectations.filter("required_verification"), events, artifacts, keys)
    parts = {
        "tool_selection": tool_selection(expectations, observed_tools(events, keys, summary), keys),
        "argument_correctness": argument_correctness(arguments, keys),
        "order_correctness": order_correctness(events, expectations, keys),
        "readback_rate": readback,
        "_artifacts": artifacts.select(*keys, F.lit(1.0).alias("_artifacts")),
    }
    no_flag = F.lit(None).cast("boolean")
    flags = ("exact", "state_changed", "verified", "required_state_change", "required_verification")

    def shape(df: DataFrame, metric: Column, value: Column, **given: Column) -> DataFrame:
        return df.select(*keys, metric.alias("metric"), value.cast("double").alias("value"),
                         *[given.get(f, no_flag).alias(f) for f in flags])

    no_metric, no_value = F.lit(None).cast("string"), F.lit(None)
    stacked = shape(run_keys, no_metric, no_value)
    stacked = stacked.unionByName(shape(
        facts, no_metric, no_value, exact=F.col("has_exact"), state_changed=F.col("state_changed"),
        verified=F.col("verified")))
    stacked = stacked.unionByName(shape(
        asked, no_metric, no_value, required_state_change=F.col("required_state_change"),
        required_verification=F.col("required_verification")))
    for name, part in parts.items():
        stacked = stacked.unionByName(shape(part, F.lit(name), F.col(name)))

    def value(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    wide = stacked.groupBy(*keys).agg(
        *[value(name).alias(name) for name in parts], *[F.bool_or(f).alias(f) for f in flags])
    changed = F.coalesce("state_changed", F.lit(False)) | F.col("_artifacts").isNotNull()
    level = F.when(F.col("exact"), "exact").when(~F.col("exact"), "coarse").otherwise("missing")
    return wide.select(
        *keys, "tool_selection", "argument_correctness", "order_correctness",
        F.when(F.col("required_state_change"), changed.cast("double")).alias("state_persistence"),
        F.when(F.col("required_verification"), F.coalesce(
            F.when(F.col("verified"), F.lit(1.0)), F.col("readback_rate"))).alias("verification_rate"),
        level.alias("evidence_level"))


def trajectory_means(structured: DataFrame) -> DataFrame:
    """(run_id, metric, value): means over all run turns, failed ones included."""
    means = structured.groupBy("run_id").agg(*[F.avg(m).alias(m) for m in TRAJECTORY_METRICS])
    return means.unpivot("run_id", list(TRAJECTORY_METRICS), "metric", "value")


def merge_trajectory(deterministic: DataFrame, judged: DataFrame, mode: str) -> DataFrame:
    """deterministic, judge, or hybrid (deterministic evidence first). Both: run_id, metric, value."""
    if mode == "deterministic":
        return deterministic
    if mode == "judge":
        return judged
    if mode != "hybrid":
        raise ValueError(f"unknown trajectory mode: {mode}")
    return deterministic.join(
        judged.withColumnRenamed("value", "_judged"), ["run_id", "metric"], "full_outer"
    ).select("run_id", "metric", F.coalesce("value", "_judged").alias("value"))


def deterministic_metrics(structured: DataFrame, mode: str) -> DataFrame:
    """(run_id, metric) whose final value rests on deterministic evidence."""
    rows = trajectory_means(structured).filter("value IS NOT NULL").select("run_id", "metric")
    return rows.limit(0) if mode == "judge" else rows


def normalize_trajectory(runs: DataFrame, source: str = "runtime.toolSummary") -> DataFrame:
    """Fill `trajectory` of freshly adapted runs, row by row.

    Exact session events when there are any, else one coarse event per summary
    tool; a missing list counts as empty; then one derived state change per artifact and a final event, with
    steps numbered through.
    """
    null = {name: F.lit(None).cast(kind) for name, kind in _event_fields().items()}

    def event(**fields: Column) -> Column:
        return F.struct(*[
            fields.get(name, null[name]).cast(kind).alias(name)
            for name, kind in _event_fields().items()])

    coarse = F.transform("tool_calls", lambda t: event(
        event_type=F.lit("tool_call"), name=t["name"], tool_name=t["name"],
        status=F.lit("unknown"), evidence_level=F.lit("coarse"),
        metadata=F.to_variant_object(F.struct(
            F.lit(source).alias("source"), t["count"].alias("count")))))
    changes = F.transform("artifacts", lambda a: event(
        event_type=F.lit("state_change"), name=F.lit("workspace_state_change"),
        status=F.lit("success"), evidence_level=F.lit("derived"),
        evidence_refs=F.array(a["path"]),
        state_after=F.to_variant_object(F.struct(
            a["path"].alias("path"), a["sha256"].alias("sha256"),
            a["size_bytes"].alias("size_bytes"), a["change"].alias("change")))))
    final = F.array(event(event_type=F.lit("final"), name=F.lit("final_answer"),
                          status=F.lit("success"), evidence_level=F.lit("exact")))
    none = F.filter(final, lambda e: F.lit(False))
    calls = F.when(F.size("exact_events") > 0, F.col("exact_events")).otherwise(F.coalesce(coarse, none))
    numbered = F.transform(
        F.concat(calls, F.coalesce(changes, none), final), lambda e, i: e.withField("step_index", (i + 1).cast("int")))
    return runs.withColumn("trajectory", numbered).drop("exact_events")


def _event_fields() -> dict[str, str]:
    inner = EVENT[len("struct<"):-1]
    return dict(part.split(": ", 1) for part in inner.split(", "))
