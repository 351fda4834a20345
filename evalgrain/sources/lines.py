"""Text files with an order key that does not depend on a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ROW_BITS = (1 << 33) - 1


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file_path, line_no, value). Files of any size stay splittable, nothing is shuffled.

    `line_no` is a key, not a count: the byte at which the line's split starts
    plus the line's place in its task. A line has at least one byte and a full
    split fills a task alone, so keys rise through a file and never repeat.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        (F.col("_metadata.file_block_start") + place + 1).alias("line_no"), "value")


def run_id_of(file_path: Column, depth: int = 2) -> Column:
    """The last `depth` folders of a file's path, which name a run."""
    parts = F.split(file_path, "/")
    return F.array_join(F.slice(parts, F.size(parts) - depth, F.lit(depth)), "/")
