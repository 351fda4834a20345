"""Block-wise ranks and totals equal plain windows, whatever the block size."""

import pytest
from pyspark.sql import Window, functions as F

from evalgrain.operators import ordered


@pytest.fixture
def data(spark):
    # One hot key holds two thirds of the rows.
    return spark.range(300).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        (F.col("id") * 37 % 1009).alias("at"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))


@pytest.mark.parametrize("block", [1, 7, 100, 1 << 20])
def test_running_totals(data, block):
    window = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    plain = data.withColumn("total", F.sum("v").over(window)) \
        .withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy("at")).cast("bigint"))
    blocked = ordered.positions(
        ordered.running_totals(data, ["key"], "at", {"total": F.col("v")}, block), ["key"], "at", block=block)
    columns = ["key", "at", "v", "total", "position"]
    assert plain.select(columns).exceptAll(blocked.select(columns)).count() == 0
    assert blocked.count() == 300


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_previous(data, block):
    window = Window.partitionBy("key").orderBy("at")
    plain = data.withColumn("previous_v", F.lag("v").over(window)).select("key", "at", "previous_v")
    found = ordered.with_previous(data, ["key"], "at", ["v"], block).select("key", "at", "previous_v")
    assert plain.exceptAll(found).count() == 0


def test_first_last_top(data, rows):
    first = ordered.first_of(data, ["key"], F.col("at"), ["at"]).withColumnRenamed("at", "low")
    last = ordered.last_of(data, ["key"], F.col("at"), ["at"]).withColumnRenamed("at", "high")
    plain = data.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    assert first.join(last, "key").exceptAll(plain).count() == 0
    assert ordered.top_k(data, ["key"], [F.desc("at")], 2).groupBy("key").count().filter("count > 2").count() == 0


def test_no_window_over_a_whole_hot_key(data):
    """The row-level window is partitioned by key and block."""
    plan = ordered.positions(data, ["key"], "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan
