"""Snapshots and histories: the one to follow, and the newest that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.plans.policy import DEFAULT


def choice(items: DataFrame, group: str, stamp: str, snapshot: str, content: Column) -> DataFrame:
    """``(group, stamp, snapshot, n_items, ties, problem)``: the snapshot of each group to follow.

    Among snapshots of the latest stamp it is the one that holds all items of the others unchanged:
    it has as many different items as all of them together, and is alone in that. ``problem`` is
    ``tied`` where none does (``snapshot`` is then null) and ``twin`` where several do. An item is
    a row's ``content``; repeated items count once. No two snapshots are compared with each other.
    """
    last = Window.partitionBy(group)
    told = items.select(group, stamp, snapshot, content.alias("_item"))
    latest = told.join(told.groupBy(group).agg(F.max(stamp).alias("_last")), group).where(F.col(stamp) == F.col("_last")).select(group, stamp, snapshot, "_item").distinct()
    each = latest.groupBy(group, stamp, snapshot).agg(F.count("*").alias("_n"))
    union = latest.select(group, "_item").distinct().groupBy(group).agg(F.count("*").alias("n_items"))
    full = each.join(union, group).withColumn("ties", F.count("*").over(last)).withColumn("_full", F.col("_n") == F.col("n_items"))
    one = full.groupBy(group, stamp, "n_items", "ties").agg(F.count_if("_full").alias("_fits"), F.min(F.when(F.col("_full"), F.col(snapshot))).alias(snapshot))
    problem = F.when(F.col("_fits") == 0, "tied").when(F.col("_fits") > 1, "twin")
    return one.select(group, stamp, F.when(F.col("_fits") == 1, F.col(snapshot)).alias(snapshot), "n_items", "ties", problem.alias("problem"))


def chosen(items: DataFrame, group: str, stamp: str, snapshot: str, content: Column) -> DataFrame:
    """``choice`` where a problem is an error."""
    found = choice(items, group, stamp, snapshot, content)
    fine = F.assert_true(F.col("problem").isNull(), F.concat(F.lit("several snapshots claim the latest stamp of "), F.col(group).cast("string"))).isNull()
    return found.where(fine).drop("problem")


def received(history: DataFrame, incoming: DataFrame, key: str, stamp: str, digest: str, keep: int = DEFAULT.reports_kept) -> DataFrame:
    """The newest ``keep`` reports of each key in history and incoming rows together.

    A report that comes again, or late, changes nothing that it would not have changed in time; two
    reports of one key and stamp with different digests are an error. Both sides have the same columns.
    """
    both = history.unionByName(incoming)
    one = both.groupBy(F.col(key).alias("_key"), F.col(stamp).alias("_stamp")).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high"), F.min_by(F.struct("*"), digest).alias("_row"))
    same = F.assert_true(F.col("_low").eqNullSafe(F.col("_high")), F.concat(F.lit("same stamp, other content: "), F.col("_key").cast("string"))).isNull()
    newest = Window.partitionBy("_key").orderBy(F.desc("_stamp"))
    return one.where(same).withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= keep).select("_row.*")
