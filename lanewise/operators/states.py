"""Health state machines in batch form: windows over each key's ordered observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.plans.policy import DEFAULT, Policy


def dead_states(rows: DataFrame, name: str, run: str, at: Column, url: str, status: str, circuit: str | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """Add ``streak`` and ``effective`` (DEAD, UNKNOWN or the observed status) to every observation.

    A streak is a run of UNKNOWN on one URL since the last GOOD, DEGRADED or change of URL; rows
    under an open circuit belong to it but do not count. Once a streak counts ``dead_after_runs``
    and is ``dead_min_age_hours`` old on a closed row, it stays DEAD to its end.
    """
    line = Window.partitionBy(name).orderBy(run)
    counts = (F.col(status) == "UNKNOWN") & (~F.coalesce(F.col(circuit), F.lit(False)) if circuit else F.lit(True))
    breaks = (F.col(status) != "UNKNOWN") | ~F.col(url).eqNullSafe(F.lag(url).over(line)) | (F.row_number().over(line) == 1)
    islands = rows.withColumn("_island", F.sum(breaks.cast("int")).over(line)).withColumn("_t", at)
    inside = Window.partitionBy(name, "_island").orderBy(run).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = islands.withColumn("streak", F.sum(counts.cast("int")).over(inside)).withColumn("_began", F.first(F.when(counts, F.col("_t")), ignorenulls=True).over(inside))
    dies = counts & (F.col("streak") >= policy.dead_after_runs) & (F.col("_t") - F.col("_began") >= policy.dead_min_age_hours * 3600)
    judged = counted.withColumn("_dead", F.max(F.coalesce(dies, F.lit(False))).over(inside))
    effective = F.when(F.col(status) != "UNKNOWN", F.col(status)).when(F.col("_dead"), "DEAD").otherwise("UNKNOWN")
    return judged.withColumn("streak", F.when(F.col(status) == "UNKNOWN", F.col("streak")).otherwise(0)).withColumn("effective", effective).drop("_island", "_t", "_began", "_dead")


def two_attempts(rows: DataFrame, key: list[str], order: list[Column], good: Column, failed: Column, circuit: Column | None = None) -> DataFrame:
    """Verdict over a key's first two attempts: GOOD, BAD (two explicit failures) or UNKNOWN."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    two = rows.select(*key, nth.alias("_n"), good.alias("_g"), failed.alias("_f"), (circuit if circuit is not None else F.lit(False)).alias("_c")).where("_n <= 2")
    pair = two.groupBy(*key).agg(
        F.max(F.when(F.col("_n") == 1, F.col("_g"))).alias("g1"), F.max(F.when(F.col("_n") == 1, F.col("_f"))).alias("f1"),
        F.max(F.when(F.col("_n") == 2, F.col("_g"))).alias("g2"), F.max(F.when(F.col("_n") == 2, F.col("_f"))).alias("f2"),
        F.bool_or("_c").alias("_c"), F.count("*").alias("attempts"),
    )
    verdict = F.when(F.col("g1"), "GOOD").when(F.col("_c"), "UNKNOWN").when(F.coalesce("g2", F.lit(False)), "UNKNOWN").when(F.col("f1") & F.coalesce("f2", F.lit(False)), "BAD").otherwise("UNKNOWN")
    return pair.select(*key, "attempts", verdict.alias("verdict"))


def candidate_verdict(status: Column, samples: Column, deep: Column, height: Column, floor: Column) -> Column:
    """QUALIFIED, REJECTED or UNKNOWN for one measured candidate."""
    good = (status == "GOOD") & (samples == 2)
    return F.when(good & deep & (F.coalesce(height, F.lit(0)) >= F.coalesce(floor, F.lit(0))), "QUALIFIED").when(status == "UNKNOWN", "UNKNOWN").otherwise("REJECTED")


def last_set(rows: DataFrame, key: str, order: list[Column], sets: Column, clears: Column) -> DataFrame:
    """Keys whose last set or clear event is a set."""
    marked = rows.where(sets | clears).select(key, F.struct(*order).alias("_o"), sets.alias("_s"))
    return marked.groupBy(key).agg(F.max_by("_s", "_o").alias("held")).where("held")


def ledger(rows: DataFrame, account: str, order: list[Column], amount: Column) -> DataFrame:
    """Add ``balance``: the running sum of an account's entries."""
    return rows.withColumn("balance", F.sum(amount).over(Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def rolling(rows: DataFrame, key: str, order: list[Column], ok: Column, keep: int = DEFAULT.history_kept) -> DataFrame:
    """Add ``recent``, the last ``keep`` outcomes as 0 and 1, this row's last."""
    line = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - keep, 0)
    return rows.withColumn("recent", F.collect_list(ok.cast("int")).over(line))
