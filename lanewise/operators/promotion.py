"""Promotions in key order under a cap by host, as deferred acceptance.

The rule is sequential: keys in order, each takes the first acceptable row whose host has not yet
promoted ``cap`` earlier keys. Seen from the hosts it is a matching: every key proposes its best
row left, every host keeps the first ``cap`` proposals by key and turns the others away for good,
and those turned away propose again. All hosts rank keys alike, so the matching is the sequential
outcome. A round is one aggregate and one ranking of proposals over all keys at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.joins import hinted
from lanewise.session import cut

HOST_CAP = 8


def promoted(
    rows: DataFrame, key: str, host: str, order: Sequence[Column], acceptable: Column, current: Column, clear: Column | None = None,
    cap: int = HOST_CAP, max_rounds: int = 1000,
) -> DataFrame:
    """The rows that are promoted, at most one a key.

    ``order`` ranks a key's rows, best first, and must leave no ties. A row marked ``current`` ends
    its key's list. ``acceptable`` rows may be promoted, unless ``clear`` is false: such a row, met
    while its host has room, ends its key's search without a promotion. Rows with a null key or host
    are never promoted. Raises if ``max_rounds`` do not suffice.
    """
    low = F.lit(False) if clear is None else ~F.coalesce(clear, F.lit(False))
    rank = F.struct(*order)
    # the rows themselves stay behind: only what decides is sorted, shuffled and kept
    marked = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(host).alias("_host"), rank.alias("_rank"), low.alias("_low"), F.coalesce(acceptable, F.lit(False)).alias("_fit"), F.coalesce(current, F.lit(False)).alias("_current"))
    ends = marked.where("_current").groupBy("_key").agg(F.min("_rank").alias("_end"))
    # of a key's rows on one host only the first can matter: where it is turned away, so are the others
    offers = marked.where("_fit AND NOT _current AND _host IS NOT NULL").groupBy("_key", "_host").agg(F.min(F.struct("_rank", "_low")).alias("_it"))
    offers = offers.select("_key", "_host", "_it.*").join(ends.hint("shuffle_hash"), "_key", "left").where("_end IS NULL OR _rank < _end").drop("_end")
    offers = cut(offers.repartition("_key"))
    full = cut(offers.select("_host", F.col("_key").alias("_last")).limit(0))  # hosts with no room after key ``_last``
    by_host = Window.partitionBy("_host").orderBy("_key")
    for _ in range(max_rounds):
        still = offers.join(hinted(full), "_host", "left").where("_last IS NULL OR _key <= _last")
        proposals = still.groupBy("_key").agg(F.min(F.struct("_rank", "_host", "_low")).alias("_best")).select("_key", "_best.*")
        held = proposals.where("NOT _low").select("_host", "_key").withColumn("_nth", F.row_number().over(by_host)).where(F.col("_nth") <= cap)
        now = cut(held.where(F.col("_nth") == cap).select("_host", F.col("_key").alias("_last")))
        if now.join(full, ["_host", "_last"], "left_anti").isEmpty():
            return _whole(rows, key, host, rank, acceptable, proposals.where("NOT _low").select("_key", "_host", "_rank"))
        full = now
    raise RuntimeError(f"promotions did not settle in {max_rounds} rounds")


def _whole(rows: DataFrame, key: str, host: str, rank: Column, acceptable: Column, chosen: DataFrame) -> DataFrame:
    """The rows of ``chosen(_key, _host, _rank)``, streamed past them unsorted; of rows that are alike in all three, one."""
    given = rows.where(acceptable).select(F.col(key).alias("_key"), F.col(host).alias("_host"), rank.alias("_rank"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rows.columns)])
    chosen = cut(chosen)
    small = hinted(chosen)
    found = given.join(chosen.hint("shuffle_hash") if small is chosen else small, ["_key", "_host", "_rank"])
    return found.dropDuplicates(["_key"]).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(rows.columns)])
