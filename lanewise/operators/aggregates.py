"""Deduplication with provenance, evidence merging, circuits and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.plans.policy import DEFAULT, Policy


def merge_sources(rows: DataFrame, key: Sequence[str], position: str, source: str) -> DataFrame:
    """One row per key: the first row's other columns, and the sorted set of all sources."""
    rest = [c for c in rows.columns if c not in (*key, source)]
    merged = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_first"), F.array_sort(F.collect_set(source)).alias("sources"))
    return merged.select(*key, "_first.*", "sources")


def best_of(rows: DataFrame, key: Sequence[str], score: Column, position: str) -> DataFrame:
    """One row per key: the highest score, the first position on ties; partial before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(score.alias("s"), (-F.col(position)).alias("p"))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_best")).select(*key, "_best.*")


def first_labels(rows: DataFrame, key: str, label: str, position: str, keep: int = DEFAULT.labels_kept) -> DataFrame:
    """At most ``keep`` different labels per key, in order of first sight."""
    once = rows.groupBy(key, label).agg(F.min(position).alias("_at"))
    return once.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("_at", label))), lambda x: x[label]), 1, keep).alias("labels"), F.count("*").alias("n_labels"))


def shared_content(rows: DataFrame, content: str, identity: str, least: int = 4) -> DataFrame:
    """Contents seen under at least ``least`` different identities."""
    return rows.groupBy(content).agg(F.count_distinct(identity).alias("n_identities")).where(F.col("n_identities") >= least)


def worst_of(rows: DataFrame, key: Sequence[str], low: Sequence[str] = (), high: Sequence[str] = (), low_positive: Sequence[str] = (), any_true: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    """Merge checks to the cautious side: smallest, largest, smallest above zero, or, set union."""
    made = [F.min(c).alias(c) for c in low] + [F.max(c).alias(c) for c in high] + [F.min(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in low_positive]
    made += [F.bool_or(c).alias(c) for c in any_true] + [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    return rows.groupBy(*key).agg(F.count("*").alias("checks"), *made)


def sample_stats(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Smallest, mean, mean of the positive values, and smallest over mean."""
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.avg(value).alias("mean"), F.avg(F.when(F.col(value) > 0, F.col(value))).alias("mean_positive"))
    return found.withColumn("steadiness", F.try_divide("lowest", "mean"))


def histogram(rows: DataFrame, value: str, floors: Sequence[int]) -> DataFrame:
    """Rows by the largest floor that the value reaches; ``other`` below all."""
    bucket = F.lit("other")
    for f in sorted(floors):
        bucket = F.when(F.col(value) >= f, str(f)).otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, column: str, k: int, position: str) -> DataFrame:
    """The ``k`` commonest values; ties in order of first sight."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(k)


def run_circuit(rows: DataFrame, run: str, status: str, policy: Policy = DEFAULT) -> DataFrame:
    """Per run: how many rows are UNKNOWN, and whether that opens the circuit."""
    counts = rows.groupBy(run).agg(F.count("*").alias("n_rows"), F.count_if(F.col(status) == "UNKNOWN").alias("n_unknown"))
    return counts.withColumn("open", (F.col("n_unknown") >= policy.circuit_min_unknown) & (F.col("n_unknown") / F.col("n_rows") >= policy.circuit_unknown_ratio))


def mass_failure(rows: DataFrame, run: str, key: str, reached: Column, policy: Policy = DEFAULT, runs: DataFrame | None = None) -> DataFrame:
    """Per run: keys that no attempt reached, and whether their number and share open the circuit.

    With ``runs``, the runs that there should be, one without any row is open too: nothing was reached.
    """
    keys = rows.groupBy(run, key).agg(F.bool_or(reached).alias("_reached"))
    counts = keys.groupBy(run).agg(F.count("*").alias("n_keys"), F.count_if(~F.coalesce("_reached", F.lit(False))).alias("n_failed"))
    if runs is not None:
        counts = runs.select(run).distinct().join(counts, run, "left").fillna(0, ["n_keys", "n_failed"])
    share = F.try_divide(F.col("n_failed"), F.col("n_keys"))
    return counts.withColumn("open", (F.col("n_keys") == 0) | (F.col("n_failed") >= policy.mass_min_keys) & (share >= policy.mass_failure_ratio))


def with_every(dimension: DataFrame, facts: DataFrame, key: str, measures: Sequence[Column]) -> DataFrame:
    """Aggregates for every key of ``dimension``; keys without facts have nulls or zero counts."""
    found = facts.groupBy(key).agg(F.count("*").alias("n"), *measures)
    return dimension.select(key).distinct().join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def duplicates(rows: DataFrame, column: str, member: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(member).alias("first_member")).where("n > 1")


def spacing(rows: DataFrame, group: Sequence[str], at: Column) -> DataFrame:
    """Mean seconds between the rows of a group; null for a single row."""
    found = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min(at).alias("_low"), F.max(at).alias("_high"))
    return found.select(*group, "n", F.try_divide(F.col("_high") - F.col("_low"), F.col("n") - 1).alias("spacing_s"))


def violations(rows: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per broken rule; a null outcome counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(broken).alias("rule"))


def asserted(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` themselves; evaluating a row that breaks a rule fails the job with the rule's name."""
    for name, ok in rules:
        rows = rows.where(F.assert_true(F.coalesce(ok, F.lit(False)), f"rule broken: {name}").isNull())
    return rows
