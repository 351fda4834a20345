"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

A stage begins by deleting the scratch tables of the one before, unless the documents it is given still read them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from evalgrain.llm.best_fit import pack
from evalgrain.llm.common import made, made_since, prepare, release, table
from evalgrain.llm.ppm_language import accept
from evalgrain.llm.simhash_pivot import keep_first
from evalgrain.llm.spaced_seed import decontaminate
from evalgrain.llm.suffix_levels import remove_repeats
from evalgrain.session import materialize


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: dict[str, list[str]] = {}  # scratch folders of the last call of a stage


def after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage that frees what the stage `before` it left."""
    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            prepare(spark)
            release(docs, _scratch.pop(before, []))
            count = made()
            out = stage(spark, docs, sf_dir)
            _scratch[stage.__name__] = made_since(count)
            return out
        return run_stage
    return wrap


@after(None)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; texts without a letter go."""
    return accept(docs)


@after("language")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_first(docs)


@after("near_duplicates")
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that also stand elsewhere."""
    return remove_repeats(docs)


@after("repeated_strings")
def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@after("benchmark_items")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in training sequences."""
    return pack(docs, added=True)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_items),
    ("best-fit packing", packing),
]

# A learned language model, similarity groups and tokens are not to be had in SQL; the tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
