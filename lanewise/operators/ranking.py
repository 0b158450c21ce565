"""Bounded, diverse and quota selections as exact window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, key: Sequence[str], order: Sequence[Column], k: Column | int) -> DataFrame:
    """The first ``k`` rows of each key; ``k`` may depend on the row. Adds ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def round_robin(rows: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Take one row of each group, then a second, and so on; large groups first. Adds ``pos``.

    Each group can supply at most ``limit`` rows, so its rank is cut there before the global order,
    which is a top-k and not a sort of all rows.
    """
    size = rows.groupBy(group).agg(F.count("*").alias("_size"))
    ranked = top_k(rows, [group], order, limit).withColumnRenamed("rank", "_turn").join(size, group)
    chosen = ranked.orderBy("_turn", F.desc("_size"), group).limit(limit)
    return chosen.withColumn("pos", F.row_number().over(Window.orderBy("_turn", F.desc("_size"), group))).drop("_turn", "_size")


def each_then_rest(rows: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """First the best row of each group, by order, then the rest by order; an empty group is no
    group. Adds ``pos``."""
    again = F.row_number().over(Window.partitionBy(group).orderBy(*order)) > 1
    marked = rows.withColumn("_later", (F.col(group) != "") & again)
    chosen = marked.orderBy("_later", *order).limit(limit)
    return chosen.withColumn("pos", F.row_number().over(Window.orderBy("_later", *order))).drop("_later")


def quotas(rows: DataFrame, group: str, core: str, quota: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """Core rows first; then each group up to its quota (its core rows count); then the rest by
    order, up to ``limit`` in all. Adds ``phase`` and ``pos``. Group order is the group's own."""
    within = Window.partitionBy(group, core).orderBy(*order)
    cores = rows.groupBy(group).agg(F.count_if(F.col(core)).alias("_cores"))
    ranked = rows.withColumn("_nth", F.row_number().over(within)).join(cores, group)
    phase = F.when(F.col(core), 0).when(F.col("_nth") + F.col("_cores") <= quota, 1).otherwise(2)
    key = [F.col("phase"), F.when(F.col("phase") == 1, F.col(group)), *order]
    phased = ranked.withColumn("phase", phase).where(F.col("_nth") <= limit)
    return phased.orderBy(*key).limit(limit).withColumn("pos", F.row_number().over(Window.orderBy(*key))).drop("_nth", "_cores")


def backups(rows: DataFrame, key: str, host: str, order: Sequence[Column], k: int) -> DataFrame:
    """After each key's best row: up to ``k`` more, each on a host not used before for the key."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    per_host = F.row_number().over(Window.partitionBy(key, host).orderBy(*order))
    firsts = rows.withColumn("_best", best).withColumn("_of_host", per_host).where("_of_host = 1")
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_best")) - 1).where(F.col("place") <= k).drop("_best", "_of_host")


def capped(rows: DataFrame, key: str, host: str, always: str, order: Sequence[Column], per_host: int, per_key: int) -> DataFrame:
    """At most ``per_host`` rows of a host and ``per_key`` of a key; ``always`` rows pass the first
    cap but count for it."""
    first = F.row_number().over(Window.partitionBy(key, host).orderBy(F.desc(always), *order))
    kept = rows.withColumn("_h", first).where(F.col(always) | (F.col("_h") <= per_host))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(always), *order))).where(F.col("rank") <= per_key).drop("_h")


def interleaved(rows: DataFrame, key: str, within: Sequence[Column], across: Sequence[Column]) -> DataFrame:
    """Rounds over keys: ``round`` is the row's index in its key; rounds follow each other."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(key).orderBy(*within)) - 1).orderBy("round", *across)


def streaks(rows: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Add ``streak``: rows since the value last changed, this one included (gaps and islands)."""
    line = Window.partitionBy(key).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(line)) | (F.row_number().over(line) == 1)).cast("int")
    marked = rows.withColumn("_island", F.sum(changed).over(line))
    return marked.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_island").orderBy(*order))).drop("_island")


def retained(rows: DataFrame, kind: Sequence[str], order: Sequence[Column], cutoff: Column) -> DataFrame:
    """The first and last row of each kind, and every row that ``cutoff`` keeps."""
    forward = F.row_number().over(Window.partitionBy(*kind).orderBy(*order))
    count = F.count("*").over(Window.partitionBy(*kind))
    return rows.withColumn("_n", forward).withColumn("_of", count).where(cutoff | (F.col("_n") == 1) | (F.col("_n") == F.col("_of"))).drop("_n", "_of")


def moved_after(rows: DataFrame, position: str, subset: Column, anchor: Column) -> DataFrame:
    """Stable move of ``subset`` behind the last ``anchor`` row. Adds ``pos``; playlists are small
    and ordered, so one ordered window numbers them."""
    everything = Window.partitionBy()
    last = F.max(F.when(anchor, F.col(position))).over(everything)
    place = F.when(subset & last.isNotNull(), F.greatest(last, F.lit(0))).otherwise(F.col(position))
    return rows.withColumn("_place", place).withColumn("_moved", subset).withColumn("pos", F.row_number().over(Window.orderBy("_place", "_moved", position))).drop("_place", "_moved")


def line_up(
    rows: DataFrame, group: str, tall: Column, order: Sequence[Column], short_order: Sequence[Column], reserved: tuple[str, int], single: str,
    capped: tuple[str, int], least: int, most: int,
) -> DataFrame:
    """A line-up of ``least`` to ``most`` rows; adds ``pos``.

    In turn: up to the number given of the reserved group, tall rows first; the best of the group
    ``single``; all ``tall`` rows in ``order`` while there is room to ``most``; the others in
    ``short_order`` and then what the cap left out, only until there are ``least``. Of the capped
    group at most the number given is taken before that. Every turn is a bounded top, so no task
    sorts the table. ``rows`` are one a station and URL, and the orders leave no ties.
    """
    (kept, n_kept), (held, n_held) = reserved, capped
    names = rows.columns
    told = rows.withColumns({"_tall": F.coalesce(tall, F.lit(False)), "_o": F.struct(*order), "_s": F.struct(*short_order)})
    of = F.coalesce(F.col(group), F.lit(""))
    first = told.where(of == kept).orderBy(F.desc("_tall"), "_o").limit(n_kept).withColumn("_turn", F.lit(1))
    best = told.where(of == single).orderBy("_o").limit(1).withColumn("_turn", F.lit(2))
    taken = first.unionByName(best)
    rest = told.join(taken.select("_o").distinct(), "_o", "left_anti").withColumn("_turn", F.when(F.col("_tall"), 3).otherwise(4))
    within = [F.col("_turn"), F.when(F.col("_turn") == 3, F.col("_o")), F.col("_s")]
    free = [rest.where(of != held).where(F.col("_turn") == turn).orderBy(*within).limit(most) for turn in (3, 4)]
    bound = rest.where(of == held).orderBy(*within).limit(n_held + least)
    nth = F.row_number().over(Window.orderBy(*within))  # of at most that many rows
    bound = bound.withColumn("_turn", F.when(nth <= n_held, F.col("_turn")).otherwise(F.col("_turn") + 2))
    every = taken
    for more in (*free, bound):
        every = every.unionByName(more.select(every.columns))
    by_rank = F.col("_turn").isin(3, 5)
    line = Window.orderBy("_turn", F.when(F.col("_turn") == 1, ~F.col("_tall")), F.when(by_rank | (F.col("_turn") < 3), F.col("_o")), "_s")
    placed = every.withColumn("pos", F.row_number().over(line))
    return placed.where(F.col("pos") <= F.when(F.col("_turn") <= 3, most).otherwise(least)).select(*names, "pos")
