"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalgrain.plans.bindings import Lake
from evalgrain.session import tune

# A task sorts and hashes about this much shuffled data at a time, compressed; rows grow several times in memory.
TASK_DATA = "16m"
# Rows of an Arrow batch: a row may hold a whole document, several times in a Python worker.
BATCH_ROWS = "256"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register `function(lake) -> DataFrame`; `oracle` is the same in DuckDB's SQL."""
    def keep(function: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = lambda spark, folder: function(Lake(_small_tasks(tune(spark)), folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return keep


def _small_tasks(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_DATA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def sql(*parts: str) -> str:
    """Common table expressions followed by the final SELECT."""
    *tables, body = [p.strip() for p in parts]
    return f"WITH {', '.join(tables)} {body}" if tables else body
