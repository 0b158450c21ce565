"""Work queues: priorities, acknowledgements, cycles, requeues, and pools built in phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scheduled(parts: Sequence[DataFrame], key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Tasks of several queues in priority order, each key once (its first queue), at most ``limit``.

    Keys are reduced to their first row before the cut; Spark limits each key to one row before the
    shuffle, so a hot key is no large group. Rows with a null key share one place.
    """
    stacked = None
    for level, part in enumerate(parts):
        some = part.withColumn("priority", F.lit(level))
        stacked = some if stacked is None else stacked.unionByName(some)
    first = stacked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("priority", *order))).where("_n = 1").drop("_n")
    return first.orderBy("priority", *order).limit(limit)


def pending(batches: DataFrame, acks: DataFrame, batch: str) -> DataFrame:
    """Delivered batches without an acknowledgement: they are sent again."""
    return batches.join(acks.select(batch).distinct(), batch, "left_anti")


def merged_queue(previous: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Both queues' rows; of one key the incoming row wins."""
    return incoming.unionByName(previous.join(incoming.select(key).distinct(), key, "left_anti"))


def requeued(results: DataFrame, key: str, now_passes: Column, done: DataFrame) -> DataFrame:
    """Rejected rows that a changed threshold now lets pass, unless they were requeued before."""
    return results.where(now_passes).join(done.select(key).distinct(), key, "left_anti")


def cycles(rows: DataFrame, owner: str, order: Sequence[Column], parts: Sequence[str]) -> DataFrame:
    """Add ``cycle``: a number that grows whenever any of the key parts changes; work of an earlier
    cycle is abandoned."""
    line = Window.partitionBy(owner).orderBy(*order)
    now = F.struct(*parts)
    changed = (~now.eqNullSafe(F.lag(now).over(line)) & (F.row_number().over(line) > 1)).cast("int")
    return rows.withColumn("cycle", F.sum(changed).over(line))


def due(jobs: DataFrame, now: Column, last: str, failures: str, base_s: int = 60, most_s: int = 3600) -> DataFrame:
    """Jobs whose back-off (doubling with every failure, capped) has run out, the fewest failures
    first; ``stalled`` from three failures on."""
    wait = F.least(F.lit(float(most_s)), F.lit(float(base_s)) * F.pow(F.lit(2.0), F.least(F.col(failures), F.lit(20))))
    return jobs.where(F.col(last).isNull() | (now - F.col(last) >= wait)).withColumn("stalled", F.col(failures) >= 3)


def probe_pool(rows: DataFrame, group: str, key: str, required: str, core: str, curated: str, score: str, item: str, quota: int) -> DataFrame:
    """Bounded pool in phases, each row once: required rows (24 a key), core rows (16 a key), the
    best row of the best ``max(45, 4q)`` keys, then second and later rows in turn until
    ``max(80, 6q)`` a group. Curated rows are always in. Adds ``phase``."""
    order = [F.desc(curated), F.desc(score), F.col(item)]
    nth = F.row_number().over(Window.partitionBy(group, key).orderBy(*order))
    ranked = rows.withColumn("_nth", nth)
    special = F.when(F.col(required) & (F.col("_nth") <= 24), 0).when(F.col(core) & (F.col("_nth") <= 16), 1)
    marked = ranked.withColumn("_special", special)
    keys = F.row_number().over(Window.partitionBy(group, F.col("_nth") == 1).orderBy(F.desc(score), item))
    first = F.when((F.col("_nth") == 1) & (keys <= max(45, 4 * quota)), 2)
    phased = marked.withColumn("_phase", F.coalesce("_special", first, F.lit(3)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_phase", "_nth", F.desc(score), item))
    kept = phased.withColumn("_place", place).where((F.col("_phase") < 3) | F.col(curated) | (F.col("_place") <= max(80, 6 * quota)))
    return kept.withColumnRenamed("_phase", "phase").drop("_nth", "_special", "_place")


def filled(stable: DataFrame, reserve: DataFrame, group: str, key: str, quota: int, order: Sequence[Column], limit: int) -> DataFrame:
    """All stable rows; then reserve rows of keys not yet there, one a key, up to the group's quota;
    then the rest by order, up to ``limit``. Adds ``phase``."""
    have = stable.groupBy(group).agg(F.count("*").alias("_have"))
    fresh = reserve.join(stable.select(key).distinct(), key, "left_anti")
    once = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    ranked = once.join(have, group, "left").withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(*order)) + F.coalesce("_have", F.lit(0)))
    more = ranked.withColumn("phase", F.when(F.col("_nth") <= quota, 1).otherwise(2)).drop("_nth", "_have")
    return stable.withColumn("phase", F.lit(0)).unionByName(more).orderBy("phase", *order).limit(limit)
