"""Names matched to targets: by a rule, by equality, by the longest target they contain.

Containment has no equality to hash on. Up to ``SMALL_ROWS`` targets go to every task once as an
Aho-Corasick automaton, which finds all targets in a text in one pass over it; beyond that the
substrings of the texts, of the targets' lengths, are joined to the targets by equality.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 100_000
_built: dict[str, Any] = {}


def _automaton(token: str, held: Broadcast) -> Any:
    """The automaton over broadcast ``(text, rank)`` pairs, built once in each worker."""
    import ahocorasick

    if token not in _built:
        made = ahocorasick.Automaton()
        for text, rank in held.value:
            made.add_word(text, rank)
        made.make_automaton()
        _built.clear()
        _built[token] = made
    return _built[token]


def best_contained(rows: DataFrame, text: Column, ranked: DataFrame, name: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add ``name``: of the targets that ``text`` contains, the one of the lowest rank, else null.

    ``ranked`` has ``(_text, _rank long, _target)``, ranks and non-empty texts being unique.
    """
    if ranked.limit(small_rows + 1).count() > small_rows:
        return _by_substrings(rows, text, ranked, name)
    found = ranked.collect()  # bounded just above
    if not found:
        return rows.withColumn(name, F.lit(None).cast("string"))
    token, held = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast([(r["_text"], r["_rank"]) for r in found])

    @F.pandas_udf("long")
    def lowest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(token, held)
        for batch in batches:
            yield pd.Series([None if t is None else min((rank for _, rank in automaton.iter(t)), default=None) for t in batch], dtype="Int64")

    shown = F.broadcast(ranked.select("_rank", F.col("_target").alias(name)))
    return rows.select(F.struct("*").alias("_in"), lowest(text).alias("_rank")).join(shown, "_rank", "left").select("_in.*", name)


def _by_substrings(rows: DataFrame, text: Column, ranked: DataFrame, name: str) -> DataFrame:
    lengths = sorted(r[0] for r in ranked.select(F.length("_text")).distinct().collect())  # at most the longest target
    texts = rows.select(text.alias("_all")).where("_all IS NOT NULL").distinct()
    parts = texts.withColumn("_n", F.explode(F.array(*map(F.lit, lengths)))).where("_n <= length(_all)").select("_all", F.explode(F.expr("sequence(1, length(_all) - _n + 1)")).alias("_at"), "_n")
    hits = parts.select("_all", F.expr("substring(_all, _at, _n)").alias("_text")).join(ranked, "_text").groupBy("_all").agg(F.min_by("_target", "_rank").alias(name))
    return rows.select(F.struct("*").alias("_in"), text.alias("_all")).join(hits, "_all", "left").select("_in.*", name)


def ranked_targets(targets: DataFrame, target: str, order: Column, form: Callable[[Column], Column]) -> DataFrame:
    """``(_text, _rank, _target)``: longest targets first, then by ``order``; of equal forms the first stays."""
    shown = targets.select(F.col(target).alias("_target"), form(F.col(target)).alias("_text"), order.alias("_order")).where("_text <> ''")
    one = shown.groupBy("_text").agg(F.min(F.struct(-F.length("_target"), "_order", "_target")).alias("_first"))
    return one.select("_text", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("_rank"), F.col("_first._target").alias("_target"))


def longest_contained(rows: DataFrame, text: str, targets: DataFrame, target: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add ``matched_<target>``: the longest target that the text contains (ties: alphabetical)."""
    ranked = ranked_targets(targets, target, F.col(target), lambda c: c)
    return best_contained(rows, F.col(text), ranked, f"matched_{target}", small_rows)


def staged(
    rows: DataFrame, name: str, targets: DataFrame, target: str, order: Column, rule: Callable[[Column], Column], form: Callable[[Column], Column],
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Add ``matched`` and ``stage``, how it was found, both null if it was not.

    * ``rule``: the key that ``rule`` reads from the name, if it is a target; a name with such a key
      has no other match, target or not.
    * ``exact``: the last target by ``order`` whose ``form`` equals the name's.
    * ``contained``: of targets without a key of their own whose form stands in the name's, the
      longest, the first by ``order`` of equally long ones.

    Null names match nothing. Target names are unique.
    """
    listed = targets.select(F.col(target).alias("_t"), order.alias("_order"))
    ruled = listed.select(F.col("_t").alias("_rule"), F.col("_t").alias("_by_rule"))
    exact = listed.select(form(F.col("_t")).alias("_form"), "_t", "_order").groupBy("_form").agg(F.max_by("_t", "_order").alias("_by_form"))
    ranked = ranked_targets(listed.where(rule(F.col("_t")).isNull()), "_t", F.col("_order"), form)
    if targets.limit(small_rows + 1).count() <= small_rows:
        ruled, exact = F.broadcast(ruled), F.broadcast(exact)
    marked = rows.select(F.struct("*").alias("_named"), rule(F.col(name)).alias("_rule"), form(F.col(name)).alias("_form"))
    marked = marked.join(ruled, "_rule", "left").join(exact, "_form", "left")
    rest = F.when(F.col("_rule").isNull() & F.col("_by_form").isNull(), F.col("_form"))
    found = best_contained(marked, rest, ranked, "_by_part", small_rows)
    stage = F.when(F.col("_rule").isNotNull(), F.when(F.col("_by_rule").isNotNull(), "rule")).when(F.col("_by_form").isNotNull(), "exact").when(F.col("_by_part").isNotNull(), "contained")
    matched = F.when(F.col("_rule").isNotNull(), F.col("_by_rule")).otherwise(F.coalesce("_by_form", "_by_part"))
    return found.select("_named.*", matched.alias("matched"), stage.alias("stage"))
