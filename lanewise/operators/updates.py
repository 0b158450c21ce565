"""Updates, merges and upserts as joins that return the new state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_update(rows: DataFrame, plan: DataFrame, key: str, value: str, old: str, new: str) -> DataFrame:
    """Set ``value`` where key and old value both match the plan; adds ``updated``."""
    p = plan.select(key, F.col(old).alias(value), F.col(new).alias("_new")).dropDuplicates([key, value])
    hit = rows.join(p, [key, value], "left")
    return hit.withColumn("updated", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", value)).select(*rows.columns, "updated")


def update_by_key(rows: DataFrame, plan: DataFrame, key: str, value: str, new: str, strict: bool = True) -> DataFrame:
    """Set ``value`` for every row of a planned key; strict fails on a planned key without a row."""
    p = plan.select(key, F.col(new).alias("_new"), F.lit(True).alias("_planned"))
    if not strict:
        return rows.join(p, key, "left").withColumn(value, F.coalesce("_new", value)).select(*rows.columns)
    both = rows.withColumn("_here", F.lit(True)).join(p, key, "full_outer")
    checked = both.where(F.assert_true(F.col("_here").isNotNull(), "a planned key has no row").isNull())
    return checked.withColumn(value, F.coalesce("_new", value)).select(*rows.columns)


def update_or_delete(rows: DataFrame, dead: DataFrame, alternatives: DataFrame, key: str, value: str, new: str) -> DataFrame:
    """Dead rows take their alternative's value, or go if there is none."""
    marked = rows.join(dead.select(key).distinct().withColumn("_dead", F.lit(True)), key, "left").join(alternatives.select(key, F.col(new).alias("_new")), key, "left")
    return marked.where("_dead IS NULL OR _new IS NOT NULL").withColumn(value, F.when(F.col("_dead"), F.col("_new")).otherwise(F.col(value))).select(*rows.columns)


def merge_in_order(rows: DataFrame, catalogue: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Replace the first row of each catalogued key, drop its later ones, append missing keys in
    catalogue order; other rows stay as they are. Adds ``pos``, the new order's sort key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(position))
    mine = rows.select(key, F.col(position).alias("_pos"), F.col(value).alias("_old"), nth.alias("_nth"))
    theirs = catalogue.select(key, F.col(position).alias("_at"), F.col(value).alias("_new"), F.lit(True).alias("_listed"))
    both = mine.join(theirs, key, "full_outer").where("_listed IS NULL OR _nth IS NULL OR _nth = 1")
    order = F.struct(F.col("_pos").isNull().alias("appended"), F.coalesce("_pos", "_at").alias("at"))
    return both.select(key, F.when(F.col("_listed"), F.col("_new")).otherwise(F.col("_old")).alias(value), order.alias("pos"))


def replace_keys(rows: DataFrame, keys: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Drop all rows of the managed keys and add the fresh ones."""
    return rows.join(keys.select(key).distinct(), key, "left_anti").unionByName(fresh)


def upsert_ttl(kept: DataFrame, fresh: DataFrame, key: str, item: str, first: str, expires: str, now: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """Unexpired rows and fresh ones by item, the fresh ones' values winning but the first sight
    kept, at most ``cap`` rows a key."""
    alive = kept.where(F.col(expires) > now)
    rest = [c for c in kept.columns if c not in (item, first)]
    a = alive.select(item, F.col(first).alias("_first_a"), F.struct(*rest).alias("_a"))
    b = fresh.select(item, F.col(first).alias("_first_b"), F.struct(*rest).alias("_b"))
    both = a.join(b, item, "full_outer").select(item, F.coalesce(F.least("_first_a", "_first_b"), "_first_a", "_first_b").alias(first), F.coalesce("_b", "_a").alias("_v"))
    merged = both.select(item, first, "_v.*")
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= cap)


def without_items(rows: DataFrame, used: DataFrame, item: str) -> DataFrame:
    return rows.join(used, item, "left_anti")


def replayed(journal: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Last write of each key."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(key, "_v.*")


def first_wins(events: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """First accepted evidence of each key: late rows never overwrite it."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(key, "_v.*")


def by_precedence(parts: Sequence[tuple[int, DataFrame]], key: str, order: Column) -> DataFrame:
    """Rows of several histories; per key the highest precedence wins, then the latest."""
    stacked = None
    for level, part in parts:
        levelled = part.withColumn("_level", F.lit(level))
        stacked = levelled if stacked is None else stacked.unionByName(levelled)
    return replayed(stacked, key, [F.col("_level"), order]).drop("_level")


def publication(latest: DataFrame, report: DataFrame) -> DataFrame:
    """``action`` for each report(run_kind, generated, digest) against the latest receipt: publish,
    skip (same or older), or conflict (same time, other content)."""
    both = report.join(latest.select("run_kind", F.col("generated").alias("_t"), F.col("digest").alias("_d")), "run_kind", "left")
    action = F.when(F.col("_t").isNull() | (F.col("generated") > F.col("_t")), "publish").when(F.col("generated") < F.col("_t"), "skip_older").when(F.col("digest") == F.col("_d"), "skip_same").otherwise("conflict")
    return both.withColumn("action", action).drop("_t", "_d")


def compacted(state: DataFrame, referenced: DataFrame, key: str, settled: Column, cutoff: Column) -> DataFrame:
    """Drop settled rows older than the cutoff unless something still refers to them."""
    mentioned = referenced.select(key).distinct().withColumn("_used", F.lit(True))
    return state.join(mentioned, key, "left").where(~(settled & cutoff) | F.col("_used").isNotNull()).drop("_used")
