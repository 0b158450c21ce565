"""Vetoes, matches, deltas and interval joins as DataFrame -> DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import urls

SMALL_ROWS = 100_000


def hinted(small: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``small`` with a broadcast hint only if a bounded count shows it to be small."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def veto(rows: DataFrame, bad: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``bad`` (null keys stay)."""
    return rows.join(bad, on, "left_anti")


def veto_hashed(rows: DataFrame, url: str, tombstones: DataFrame, digest: str) -> DataFrame:
    """Rows whose URL's SHA-256 is not in ``tombstones``; hashes may be of any case."""
    gone = tombstones.select(F.lower(digest).alias("_digest")).distinct()
    return rows.withColumn("_digest", F.sha2(F.trim(url), 256)).join(gone, "_digest", "left_anti").drop("_digest")


def equivalent_reasons(rows: DataFrame, url: str, listed: Column, order: Sequence[str], history: DataFrame, history_url: str, history_listed: Column) -> DataFrame:
    """Add ``reason``: ``history`` where a listed row's route is, but for its variant, one of the listed
    history's; ``batch`` where an earlier row in ``order``, itself not excluded, has it; else null.

    ``order`` names columns that tell rows apart. Rows that are not listed have no reason.
    """
    known = history.where(history_listed).select(urls.equivalent(F.col(history_url)).alias("_route")).where("_route IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    keyed = rows.select(F.struct("*").alias("_in"), F.when(listed, urls.equivalent(F.col(url))).alias("_route"), F.struct(*order).alias("_order"))
    first = keyed.where("_route IS NOT NULL").groupBy("_route").agg(F.min("_order").alias("_first"))
    both = keyed.join(known, "_route", "left").join(first, "_route", "left")
    reason = F.when(F.col("_known"), "history").when(F.col("_order") > F.col("_first"), "batch")
    return both.select("_in.*", reason.alias("reason"))


def bad_hosts(bad: DataFrame, url: str, least: int = 2) -> DataFrame:
    """Hosts with at least ``least`` different bad URLs."""
    return bad.select(urls.host(F.col(url)).alias("host"), F.col(url).alias("_u")).where("host <> ''").groupBy("host").agg(F.count_distinct("_u").alias("n_urls")).where(F.col("n_urls") >= least)


def veto_hosts(rows: DataFrame, url: str, bad: DataFrame, bad_url: str, least: int = 2) -> DataFrame:
    return rows.withColumn("_host", urls.host(F.col(url))).join(bad_hosts(bad, bad_url, least).select(F.col("host").alias("_host")), "_host", "left_anti").drop("_host")


def first_reason(rows: DataFrame, vetoes: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Add ``reason``: the name of the first veto whose key matches, in the order given; else null."""
    marks = []
    for i, (name, bad, on) in enumerate(vetoes):
        rows = rows.join(bad.select(*on).distinct().withColumn(f"_veto{i}", F.lit(name)), list(on), "left")
        marks.append(f"_veto{i}")
    return rows.withColumn("reason", F.coalesce(*marks) if marks else F.lit(None).cast("string")).drop(*marks)


def attach(rows: DataFrame, extra: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Left join with the other side's columns in one struct ``name``, null where it has no row."""
    packed = extra.select(*on, F.struct(*[c for c in extra.columns if c not in on]).alias(name))
    return rows.join(packed, list(on), "left")


def ambiguous(rows: DataFrame, item: str, identity: str) -> DataFrame:
    """Items that stand for more than one identity, with their number."""
    return rows.groupBy(item).agg(F.count_distinct(identity).alias("n_identities")).where("n_identities > 1")


def consensus(rows: DataFrame, item: str, target: str, lenient: bool = False) -> DataFrame:
    """Items all of whose rows agree on one target; strict also rejects items with a null target."""
    agreed = rows.groupBy(item).agg(F.count_distinct(target).alias("_n"), F.count_if(F.col(target).isNull()).alias("_none"), F.min(target).alias(target))
    return agreed.where("_n = 1" if lenient else "_n = 1 AND _none = 0").drop("_n", "_none")


def digest_of(columns: Sequence[str]) -> Column:
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\n", *shown), 256)


def delta(now: DataFrame, before: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, change)`` of rows that are new, changed (by content digest) or gone."""
    a = now.select(key, digest_of(columns).alias("_now"))
    b = before.select(key, digest_of(columns).alias("_before"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_before"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, carried: Sequence[str], within: Column | None = None, tie: str | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    One union and one window over the key: no row pairs are made, so a key with many rows on both
    sides costs a sort, not a product. ``tie`` orders right rows of one time; ``within`` is the
    largest age, as an interval, beyond which the carried columns are null.
    """
    order = F.lit(0) if tie is None else F.col(tie).cast("long")
    a = left.select(key, F.struct(*left.columns).alias("_left"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.lit(None).cast(right.select(F.struct(right_at, *carried)).schema[0].dataType).alias("_right"))
    b = right.select(key, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.col(right_at).alias("_t"), F.lit(0).alias("_side"), order.alias("_tie"), F.struct(right_at, *carried).alias("_right"))
    line = Window.partitionBy(key).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = a.unionByName(b).withColumn("_hit", F.last("_right", ignorenulls=True).over(line)).where("_side = 1")
    if within is not None:
        seen = seen.withColumn("_hit", F.when(F.col("_t") - F.col(f"_hit.{right_at}") <= within, F.col("_hit")))
    return seen.select("_left.*", *[F.col(f"_hit.{c}").alias(c) for c in carried])


def equivalent_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b (as multisets), and whether the two are equal."""
    extra = a.exceptAll(b).select(F.lit("a").alias("side")).unionByName(b.exceptAll(a).select(F.lit("b").alias("side")))
    counts = extra.agg(F.count_if(F.col("side") == "a").alias("only_a"), F.count_if(F.col("side") == "b").alias("only_b"))
    return counts.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def mismatches(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys missing, unexpected or of another value: empty if both sides are the same."""
    a, b = expected.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), actual.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    problem = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def imported(pending: DataFrame, incoming: DataFrame, key: str, rebuild: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pending`` and those incoming rows that it lacks and that last when both are rebuilt together.

    ``rebuild`` maps rows to the rows it allows, so labels that conflict across batches keep a new row out;
    nothing pending is lost. Of incoming rows with one key, one is added.
    """
    allowed = rebuild(pending.unionByName(incoming)).select(key)
    fresh = incoming.join(pending.select(key), key, "left_anti").join(allowed, key, "left_semi").dropDuplicates([key])
    return pending.unionByName(fresh)
