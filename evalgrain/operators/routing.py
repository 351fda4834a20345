"""Routing metrics: which skills a model chose against which it should have chosen.

Input of `judge`: run_id, case_id, repeat_index, expected (array), selected
(array), ok, severity, type, stage, line_no. Every metric is per run and comes
out of one aggregation pass that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalgrain.functions.text import CASE_STAGES, CASE_TYPES, NO_LABEL
from evalgrain.operators import ordered
from evalgrain.operators.joins import evaluable_routing_runs

METRICS = (
    "exact_set_match", "top1", "multi_exact", "no_skill_rejection", "false_activation",
    "critical_miss", *[f"type_{t}" for t in CASE_TYPES], *[f"stage_{s}" for s in CASE_STAGES],
)


def as_set(labels: Column) -> Column:
    return F.sort_array(F.array_distinct(labels))


def first_label(labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit(NO_LABEL))


def with_gold(cases: DataFrame) -> DataFrame:
    """Add what `judge` needs from `expected`. Done per case, before the join with runs."""
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    return cases.withColumns({
        "expected_set": as_set(expected), "n_expected": F.size(F.array_distinct(expected)),
        "truth": first_label(expected)})


def judge(rows: DataFrame) -> DataFrame:
    """Evaluable rows with `exact`, `n_expected`, `truth` and `predicted`."""
    known = rows if "expected_set" in rows.columns else with_gold(rows)
    selected = F.coalesce("selected", F.array().cast("array<string>"))
    return evaluable_routing_runs(known).select(
        "run_id", "case_id", "repeat_index", "severity", "type", "stage", "line_no", "n_expected",
        (F.col("expected_set") == as_set(selected)).alias("exact"), "truth",
        first_label(selected).alias("predicted"),
    )


def _rate(condition: Column, flag: Column) -> Column:
    """Share of `flag` among rows meeting the condition; NULL when no row does."""
    return F.avg(F.when(condition, flag.cast("double")))


def scores(judged: DataFrame) -> DataFrame:
    """One wide row per run with every routing metric."""
    exact, anything = F.col("exact"), F.lit(True)
    rejection = _rate(F.col("n_expected") == 0, exact)
    return judged.groupBy("run_id").agg(
        _rate(anything, exact).alias("exact_set_match"),
        _rate(F.col("n_expected") == 1, F.col("truth") == F.col("predicted")).alias("top1"),
        _rate(F.col("n_expected") > 1, exact).alias("multi_exact"),
        rejection.alias("no_skill_rejection"),
        (1 - rejection).alias("false_activation"),
        (1 - _rate(F.col("severity") == "critical", exact)).alias("critical_miss"),
        *[_rate(F.col("type") == t, exact).alias(f"type_{t}") for t in CASE_TYPES],
        *[_rate(F.col("stage") == s, exact).alias(f"stage_{s}") for s in CASE_STAGES],
    )


def long_scores(wide: DataFrame, metrics: tuple[str, ...] | list[str], keys: list[str] | None = None
                ) -> DataFrame:
    """(keys, metric, value), NULL values kept: N/A is a result."""
    return wide.unpivot(keys or ["run_id"], list(metrics), "metric", "value")


def _by(judged: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    return judged.filter(F.col(column).isin(*known)).groupBy("run_id", column).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("exact").cast("double")).alias("accuracy"))


def by_type(judged: DataFrame) -> DataFrame:
    return _by(judged, "type", CASE_TYPES)


def by_stage(judged: DataFrame) -> DataFrame:
    return _by(judged, "stage", CASE_STAGES)


def confusion_matrix(judged: DataFrame) -> DataFrame:
    """Cells with a count, over cases that expect at most one skill; see `dense_confusion` for zeros."""
    return judged.filter("n_expected <= 1").groupBy("run_id", "truth", "predicted") \
        .agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """One row per run and true label, one column per predicted label, zeros filled in.

    `labels` is the axis: the skills of the catalog and the no-skill label.
    """
    runs = matrix.select("run_id").distinct() \
        .withColumn("truth", F.explode(F.array(*[F.lit(x) for x in labels])))
    counts = matrix.groupBy("run_id", "truth").agg(*[
        F.sum(F.when(F.col("predicted") == x, F.col("n"))).alias(x) for x in labels])
    return runs.join(counts, ["run_id", "truth"], "left").fillna(0, labels)


def confusion_labels(matrix: DataFrame) -> DataFrame:
    """The label axis of each run's matrix, the no-skill label last."""
    labels = matrix.select("run_id", F.explode(F.array("truth", "predicted")).alias("label")) \
        .distinct()
    return labels.withColumn("is_none", F.col("label") == NO_LABEL)


def filled_confusion(matrix: DataFrame) -> DataFrame:
    """All cells (run_id, truth, predicted, n) over each run's own labels, zeros filled in."""
    labels = confusion_labels(matrix)
    cells = labels.select("run_id", F.col("label").alias("truth")).join(
        labels.select("run_id", F.col("label").alias("predicted")), "run_id")
    return cells.join(matrix.select("run_id", "truth", "predicted", "n"), ["run_id", "truth", "predicted"], "left") \
        .fillna(0, ["n"])


def per_label(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; a division by zero counts as 0."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = matrix.select("run_id", F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("chosen"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("chosen"), F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")).select("run_id", "s.*")
    totals = sides.groupBy("run_id", "label").agg(
        F.sum("hits").alias("hits"), F.sum("chosen").alias("chosen"),
        F.sum("support").alias("support"))

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    return totals.select(
        "run_id", "label",
        share(F.col("hits"), F.col("chosen")).alias("precision"),
        share(F.col("hits"), F.col("support")).alias("recall"),
        share(2 * F.col("hits"), F.col("chosen") + F.col("support")).alias("f1"),
        "support")


def top_confusions(matrix: DataFrame, k: int = 5) -> DataFrame:
    wrong = matrix.filter("truth <> predicted")
    order = [F.desc("n"), F.desc("truth"), F.desc("predicted")]
    return ordered.top_k(wrong, ["run_id"], order, k)


def run_counts(rows: DataFrame) -> DataFrame:
    """Attempted and evaluable runs, cases among the evaluable ones, whole runs per case."""
    ok = F.coalesce(F.col("ok"), F.lit(True))
    counts = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(ok).alias("evaluable"),
        F.count_distinct(F.when(ok, F.col("case_id"))).alias("n_cases"))
    return counts.withColumn(
        "runs_per_case", F.floor(F.try_divide(F.col("evaluable"), F.col("n_cases"))))


def with_empty_runs(run_dim: DataFrame, per_run: DataFrame) -> DataFrame:
    """Keep runs without a single evaluable row: their metrics are NULL, the row stays."""
    return run_dim.select("run_id").join(per_run, "run_id", "left")
