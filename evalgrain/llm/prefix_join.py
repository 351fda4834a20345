"""Similar sets by prefix filtering: every pair that is similar enough, without comparing all pairs.

Method: all sets are read in one order of the shingles, those of few sets first. The shingles that two sets share all
stand from the first shared one on, in either set. So that one has to stand early enough in both for enough shingles to
follow, and an equi-join on such early shingles finds the pair. Sets of a template whose own words make them too
different have only shingles of their own there and meet nothing, however many they are.

`join_crowds` completes groups in which only some pairs were compared: the rows outside a crowd's largest group are first
compared with a few of its members, which joins most of what belongs together; what is left apart meets in near_sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalgrain.llm.common import components, materialize

HUBS = 2  # members of a crowd's largest group that all its other rows are compared with first, where rows are in many crowds


def near_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ra, rb): pairs of rows of `sets` (row, root, shingles) that may have 100 * intersection >= percent * union.

    Only pairs of different roots are looked for, so shingles of one root count as shared with nobody. No pair that is
    similar enough is left out; those found have to be confirmed on the full sets. No set may be empty or hold repeats.
    """
    each = sets.select("row", "root", F.explode("shingles").alias("shingle"))
    shared = (each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y"))
              .where("x <> y").select("shingle", "c"))
    # One row's own shared shingles, at most the set it came from.
    ordered = each.join(shared, "shingle").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("shared"))
    early = (sets.select("row", "root", F.size("shingles").alias("n")).join(ordered, "row")
             .where(100 * F.size("shared") >= percent * F.col("n"))
             .select("row", "root", "n", F.size("shared").alias("m"), F.posexplode("shared").alias("place", "at"))
             .select("row", "root", "n", "at.shingle", (F.col("m") - F.col("place")).alias("rest"))
             .where(100 * F.col("rest") >= percent * F.col("n")))
    # The smaller set of a pair shares more of its shingles, so that fewer of them come first.
    small = early.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("n"))
    x = early.select("shingle", *(F.col(c).alias(d) for c, d in (("row", "a"), ("root", "ra"), ("n", "na"), ("rest", "xa"))))
    y = small.select("shingle", *(F.col(c).alias(d) for c, d in (("row", "b"), ("root", "rb"), ("n", "nb"), ("rest", "xb"))))
    enough = (100 + percent) * F.least("xa", "xb") >= percent * (F.col("na") + F.col("nb"))
    return (x.join(y, "shingle").where("ra <> rb AND (na > nb OR na = nb AND a < b)")
            .where(enough & (100 * F.col("nb") >= percent * F.col("na"))).select("a", "b", "ra", "rb").distinct())


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose full sets (row, shingles) have 100 * intersection >= percent * union."""
    x = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(
        100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select(*pairs.columns)


def apart(crowds: DataFrame, grouped: DataFrame) -> DataFrame:
    """(key, row, root, top): the crowds (key, row) that hold more than one group (row, root); top is their largest."""
    labelled = crowds.join(grouped, "row", "left").withColumn("root", F.coalesce("root", "row"))
    per = labelled.groupBy("key", "root").agg(F.count("*").alias("c"))
    top = per.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
    return labelled.join(top.where("roots > 1").select("key", F.col("top.root").alias("top")), "key")


def hub_pairs(loose: DataFrame, hubs: int) -> DataFrame:
    """(a, b, ra, rb): rows outside the largest group of a crowd (key, row, root, top) with a few members of it."""
    few = loose.where("root = top").groupBy("key").agg(F.array_distinct(F.array(*(
        F.min_by("row", F.xxhash64("row", "key", F.lit(k))) for k in range(hubs)))).alias("hubs"))
    return loose.where("root <> top").join(few, "key").select(
        F.col("row").alias("a"), F.explode("hubs").alias("b"), F.col("root").alias("ra"), F.col("top").alias("rb")).distinct()


def merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """(row, root) after the links (ra, rb) between roots; rows that were in no component and now are come too."""
    upper = materialize(components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "upper")
    members = grouped.unionByName(upper.select(F.col("node").alias("row"), F.col("node").alias("root"))).distinct()
    return materialize(members.join(upper.select("node", F.col("root").alias("up")), members.root == F.col("node"), "left")
                       .select("row", F.coalesce("up", "root").alias("root")), "merged")


def join_crowds(crowds: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int, hubs: int = HUBS) -> DataFrame:
    """(row, root): the groups (row, root) after all links between rows of a crowd (key, row), sets are (row, shingles)."""
    loose = materialize(apart(crowds, grouped), "loose")
    grouped = merged(grouped, similar(hub_pairs(loose, hubs), sets, percent))
    left = materialize(apart(loose.select("key", "row"), grouped).select("row", "root").distinct(), "left")
    more = materialize(near_sets(sets.join(left, "row"), percent), "across")
    return merged(grouped, similar(more, sets, percent))
