"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalgrain.session import new_folder, tune

# Arrow batches stay small because one row may hold a very long text.
BATCH_ROWS = "512"


_folders: list[str] = []


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new shared folder for tables that nobody needs once the result built on them is written."""
    _folders.append(new_folder(spark, label))
    return _folders[-1]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write a table to a scratch folder and read it back."""
    path = scratch_folder(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_since(count: int) -> list[str]:
    """The scratch folders made after the first `count`."""
    return _folders[count:]


def made() -> int:
    return len(_folders)


def release(docs: DataFrame, folders: list[str]) -> None:
    """Delete scratch folders of a result that was written, unless docs still reads from one of them."""
    spark = docs.sparkSession
    names = {folder.rstrip("/").rsplit("/", 1)[1] for folder in folders}
    if any(part in names for file in docs.inputFiles() for part in file.split("/")):
        return
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        path = path_of(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return tune(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function that yields dicts of columns."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for columns in function(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable.

    Alternates large stars and small stars: each node's larger, then smaller, neighbours move to its smallest one.
    Every round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
    The number of rounds grows with the logarithm of the longest path. No edges: no rows.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = materialize(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "small_star")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
