"""User scoring functions over the shared tables."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalgrain.operators.gates import merge_scalar_metrics


@dataclass(frozen=True)
class Tables:
    """What an evaluator may read. Every evaluator gets the same tables."""

    runs: DataFrame
    cases: DataFrame | None = None
    scores: DataFrame | None = None
    rows: DataFrame | None = None
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Evaluator:
    name: str
    version: str
    function: Callable[[Tables], DataFrame]
    exposed: bool = True


_EVALUATORS: dict[str, Evaluator] = {}


def register_evaluator(name: str, version: str, exposed: bool = True):
    """Register `function(tables) -> DataFrame(run_id, metric, value)` under a name."""
    if not version:
        raise ValueError(f"evaluator {name!r} needs a version")

    def keep(function):
        known = _EVALUATORS.get(name)
        if known is not None and known.function is not function:
            raise ValueError(f"evaluator {name!r} is already registered")
        _EVALUATORS[name] = Evaluator(name, version, function, exposed)
        return function

    return keep


def available() -> list[str]:
    return sorted(_EVALUATORS)


def find(name: str) -> Evaluator:
    if name not in _EVALUATORS:
        raise ValueError(f"unknown evaluator {name!r}; known: {available()}")
    return _EVALUATORS[name]


def evaluate(names: list[str], tables: Tables) -> DataFrame:
    """(run_id, evaluator, metric, value, exposed) of all named evaluators, in any order."""
    parts = []
    for name in names:
        evaluator = find(name)
        parts.append(evaluator.function(tables).select(
            "run_id", F.lit(name).alias("evaluator"), "metric",
            F.col("value").cast("double").alias("value"), F.lit(evaluator.exposed).alias("exposed")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gate_metrics(names: list[str], tables: Tables) -> DataFrame:
    return merge_scalar_metrics(evaluate(names, tables))


def manifest(spark: SparkSession, names: list[str]) -> DataFrame:
    """Which code produced the metrics: name, version, source hash, exposure."""
    rows = []
    for name in names:
        evaluator = find(name)
        source = inspect.getsourcefile(evaluator.function)
        digest = hashlib.sha256(Path(source).read_bytes()).hexdigest() if source else None
        rows.append((name, evaluator.version, evaluator.function.__module__,
                     f"sha256:{digest}" if digest else None, evaluator.exposed))
    return spark.createDataFrame(
        rows, "name string, version string, module string, source_sha256 string, exposed boolean")
