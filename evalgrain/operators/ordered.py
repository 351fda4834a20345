"""Ranks, running totals and neighbours inside groups of any size.

A plain window sorts a whole group in one task, which fails when one run, case
or customer holds a third of the rows. Here a group is split into blocks of its
order column: the window runs inside a block, and a second window over one row
per block carries the totals across. `order` must be a BIGINT, unique in its
group; a block then never holds more than `block` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 1 << 20


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.expr(f"`{order}` div {block}L"))


def running_totals(
    df: DataFrame, keys: list[str], order: str, totals: dict[str, Column], block: int = BLOCK,
) -> DataFrame:
    """Add, per name, the sum of its expression over the group up to and including the row."""
    rows = _blocked(df, order, block).withColumns(
        {f"_v_{name}": value for name, value in totals.items()})
    block_sums = rows.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in totals])
    earlier = Window.partitionBy(*keys).orderBy("_block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = block_sums.select(
        *keys, "_block",
        *[F.sum(f"_s_{name}").over(earlier).alias(f"_o_{name}") for name in totals])
    inside = Window.partitionBy(*keys, "_block").orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, [*keys, "_block"]).withColumns(
        {f"_w_{name}": F.sum(f"_v_{name}").over(inside) for name in totals})
    return joined.withColumns({
        name: F.when(F.col(f"_w_{name}").isNotNull() | F.col(f"_o_{name}").isNotNull(),
                     F.coalesce(f"_w_{name}", F.lit(0)) + F.coalesce(f"_o_{name}", F.lit(0)))
        for name in totals
    }).drop("_block", *[f"_{part}_{name}" for part in "vow" for name in totals])


def positions(
    df: DataFrame, keys: list[str], order: str, name: str = "position", block: int = BLOCK,
) -> DataFrame:
    """Add the 1-based rank of each row in its group."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, block)


def with_previous(
    df: DataFrame, keys: list[str], order: str, columns: list[str], block: int = BLOCK,
) -> DataFrame:
    """Add `previous_<column>` of the row before; NULL on the first row.

    The neighbour is found by an equi-join on the rank, not by a window.
    """
    ranked = positions(df, keys, order, "_rank", block)
    before = ranked.select(
        *keys, (F.col("_rank") + 1).alias("_rank"),
        *[F.col(c).alias(f"previous_{c}") for c in columns])
    return ranked.join(before, [*keys, "_rank"], "left").withColumnRenamed("_rank", "position")


def first_of(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """One row per group: its columns at the smallest order value, which must be unique.

    Combines before the shuffle; for fixed-width columns in a hash table.
    """
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in columns])


def last_of(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in columns])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first `k` rows per group. Spark keeps `k` rows per group and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)
