"""Selections with interacting counters: each pick changes what the next one costs.

Two of them have a closed form as ranks. Two are folded in key order with one running state
(``folds``), so a group of any size passes through a task row by row. ``balanced`` has neither; its
groups are first reduced to the rows that ``limit`` picks can reach at all, which leaves at most
``limit`` rows for each host and channel, and picked from those with a heap.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import urls
from lanewise.operators.folds import Event, Rule, State, Stepped, folded


def _shape(rows: DataFrame, *leave: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in leave)


def reachable(rows: DataFrame, group: str, host: str, channel: str, priority: str, item: str, limit: int) -> DataFrame:
    """The rows that ``limit`` picks of ``balanced`` can reach, and perhaps a few more.

    Rows of one host, channel and priority are picked in item order, so the first ``limit`` do. Of a
    host's channels, or a channel's hosts, with one priority, those count whose first item is among
    the ``limit`` smallest: of these, one is still unused and comes before any other.
    """
    key = [group, host, channel, priority]
    heads = rows.groupBy(*key).agg(F.min(item).alias("_head"))
    ranked = heads.withColumns({
        "_c": F.row_number().over(Window.partitionBy(group, host, priority).orderBy("_head")),
        "_h": F.row_number().over(Window.partitionBy(group, channel, priority).orderBy("_head")),
    })
    kept = ranked.where((F.col("_c") <= limit) & (F.col("_h") <= limit)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(item))
    return rows.join(kept, same, "left_semi").withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def balanced(rows: DataFrame, group: str, host: str, channel: str, priority: str, item: str, limit: int) -> DataFrame:
    """Again and again the row with the least-used host, then priority, then the least-used channel, then
    the smallest item (unique in its group). Null hosts and channels count as one each."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(item).reset_index(drop=True)
        hosts, channels, chosen = Counter(), Counter(), []
        queues: dict[tuple, list[int]] = {}
        said = frame[[host, channel, priority]].astype(object).where(frame[[host, channel, priority]].notna(), None)
        for i, (h, c, p) in enumerate(said.itertuples(index=False, name=None)):
            queues.setdefault((h, c, bool(p)), []).append(i)
        keys = list(queues)
        heap = [(0, not p, 0, queues[h, c, p][0], n, 0) for n, (h, c, p) in enumerate(keys)]
        heapq.heapify(heap)
        while heap and len(chosen) < limit:
            used, last, busy, i, n, at = heapq.heappop(heap)
            h, c, p = keys[n]
            if (hosts[h], channels[c]) != (used, busy):  # counters only grow: it comes back later
                heapq.heappush(heap, (hosts[h], last, channels[c], i, n, at))
                continue
            chosen.append(i)
            hosts[h] += 1
            channels[c] += 1
            if at + 1 < len(queues[h, c, p]):
                heapq.heappush(heap, (hosts[h], last, channels[c], queues[h, c, p][at + 1], n, at + 1))
        return frame.loc[chosen].assign(pos=pd.Series(range(1, len(chosen) + 1), index=chosen, dtype="int32"))

    return reachable(rows, group, host, channel, priority, item, limit).groupBy(group).applyInPandas(pick, f"{_shape(rows)}, pos int")


def rotating(rows: DataFrame, group: str, host: str, rejected: str, item: str, limit: int) -> DataFrame:
    """Hosts in rotation; a host's earlier rejections hold it back by up to two turns.

    A host's rows wait for one more turn each, so the picks are the rows by turn, then item.
    """
    mine = Window.partitionBy(group, host)
    held = F.floor(F.least(F.greatest(F.coalesce(F.max(rejected).over(mine), F.lit(0)), F.lit(0)) / 2, F.lit(2)))
    waiting = rows.withColumn("_nth", F.row_number().over(mine.orderBy(item))).withColumn("_held", held).where(F.col("_nth") <= limit)
    turn = Window.partitionBy(group).orderBy(F.col("_nth") + F.col("_held"), item)
    return waiting.withColumn("pos", F.row_number().over(turn)).where(F.col("pos") <= limit).drop("_nth", "_held")


def topped_up(pool: DataFrame, day: DataFrame, channel: str, url: str, last: str, item: str, listed: str, limit: int) -> DataFrame:
    """Routes to measure once more, oldest check first, hosts in rotation; adds ``pos``.

    Left out are routes of several channels, routes in ``day`` (what was measured or reserved today,
    with the same columns) and, for ``listed`` stations, variants of those; of a listed station's
    variants, which stand on one host, the first remains.
    """
    route = F.when(F.col(listed), urls.equivalent(F.col(url)))
    shared = pool.groupBy(url).agg(F.count_distinct(channel).alias("_owners")).where("_owners > 1").select(url)
    done = day.where(listed).select(route.alias("_route")).distinct()
    open_ = pool.join(shared, url, "left_anti").join(day.select(url), url, "left_anti").withColumn("_route", route).join(done, "_route", "left_anti")
    first = Window.partitionBy(channel, F.coalesce("_route", F.concat(F.lit("\n"), F.col(item).cast("string")))).orderBy(last, item)
    single = open_.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_route")
    host = Window.partitionBy("_host").orderBy(last, item)
    turns = single.withColumn("_host", urls.host(F.col(url))).withColumn("_turn", F.row_number().over(host)).where(F.col("_turn") <= limit)
    near = turns.orderBy("_turn", last, item).limit(limit)  # the window below sees ``limit`` rows
    return near.withColumn("pos", F.row_number().over(Window.orderBy("_turn", last, item))).select(*pool.columns, "pos")


def penalised(rows: DataFrame, group: str, key: str, host: str, score: str, penalty: float) -> DataFrame:
    """Per key, in key order, the row with the best score less ``penalty`` for each earlier use of its host."""
    fields = rows.drop(group).columns

    def step(state: State | None, e: Event) -> Stepped:
        s = state or {"used": {}, "key": None, "best": None, "worth": None, "n": 0}
        if e["_part"]:
            best, n = s["best"], s["n"] + 1
            used = s["used"] | {best[host]: s["used"].get(best[host], 0) + 1}
            return Stepped(s | {"used": used, "best": None, "n": n}, [{f: best[f] for f in fields} | {"pos": n}], [])
        worth = e[score] - penalty * s["used"].get(e[host], 0)
        if s["best"] is None:
            close = dict.fromkeys(e) | {key: e[key], "_part": 1}
            return Stepped(s | {"best": e, "worth": worth}, [], [close])
        return Stepped(s | {"best": e, "worth": worth} if worth > s["worth"] else s, [], [])

    marked = rows.where(F.col(score).isNotNull()).withColumns({"_part": F.lit(0), "_neg": -F.col(score)})
    rule = Rule(step, (key, "_part", "_neg", host), _shape(marked, group), "", f"{_shape(rows, group)}, pos int")
    return folded(marked, [group], rule)


def capped_category(rows: DataFrame, group: str, category: str, capped: str, cap: int, order: str, limit: int) -> DataFrame:
    """In order, up to ``limit`` rows, of which at most ``cap`` of the category ``capped``: two ranks, groups of any size."""
    held = F.col(category).eqNullSafe(F.lit(capped))
    nth = F.row_number().over(Window.partitionBy(group, held).orderBy(order))
    fit = rows.withColumn("_nth", nth).where(~held | (F.col("_nth") <= cap)).drop("_nth")
    return fit.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("pos") <= limit)


def admitted(rows: DataFrame, group: str, cost: str, order: str, budget: float) -> DataFrame:
    """In order, every row whose cost still fits what is left of the budget."""
    fields = rows.drop(group).columns

    def step(state: State | None, e: Event) -> Stepped:
        s = state or {"left": budget, "n": 0}
        if e[cost] is None or e[cost] > s["left"]:
            return Stepped(s, [], [])
        return Stepped({"left": s["left"] - e[cost], "n": s["n"] + 1}, [{f: e[f] for f in fields} | {"pos": s["n"] + 1}], [])

    return folded(rows, [group], Rule(step, (order,), _shape(rows, group), "", f"{_shape(rows, group)}, pos int"))
