"""Land run logs as Parquet while they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from evalgrain import schemas
from evalgrain.sources.lines import run_id_of
from evalgrain.sources.runs import normalize_runs


def stream_runs(spark: SparkSession, path: str, depth: int = 2) -> DataFrame:
    """New run records under `path`, normalized like `read_runs`; files are read once complete."""
    lines = spark.readStream.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), "value").filter(F.trim("value") != "")
    parsed = lines.select(
        run_id_of(F.col("file_path"), depth).alias("run_id"),
        F.from_json("value", schemas.RUNS, {"mode": "FAILFAST"}).alias("_r"))
    return normalize_runs(parsed.select("run_id", "_r.*"))


def land_runs(spark: SparkSession, path: str, table: str, state: str, depth: int = 2,
              once: bool = False) -> StreamingQuery:
    """Append the stream to a Parquet table partitioned by run_id; `state` makes it restartable."""
    writer = stream_runs(spark, path, depth).writeStream.format("parquet").outputMode("append") \
        .option("path", table).option("checkpointLocation", state).partitionBy("run_id")
    return (writer.trigger(availableNow=True) if once else writer).start()
