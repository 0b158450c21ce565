"""Rolling success arrays, bounded lists, canonical digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KEPT = 12


def appended(history: Column, value: Column, keep: int = KEPT) -> Column:
    """``history`` with ``value`` at its end, the newest ``keep`` only."""
    longer = F.concat(F.coalesce(history, F.array().cast("array<int>")), F.array(value.cast("int")))
    return F.slice(longer, F.greatest(F.size(longer) - keep + 1, F.lit(1)), F.lit(keep))


def trailing(recent: Column) -> Column:
    """Length of the run of ones at the end."""
    zero = F.array_position(F.reverse(recent), 0)
    return F.when(F.size(recent) == 0, 0).when(zero == 0, F.size(recent)).otherwise(zero.cast("int") - 1)


def ratio(recent: Column) -> Column:
    return F.when(F.size(recent) > 0, F.aggregate(recent, F.lit(0), lambda a, x: a + x) / F.size(recent))


def history_score(recent: Column) -> Column:
    """Reward for routes that keep passing: share, trailing run, and two penalties."""
    share, n = ratio(recent), F.size(recent)
    score = (share - 0.5) * 150 + F.least(trailing(recent), F.lit(6)) * 9
    score = score - F.when((n >= 4) & (share < 0.6), 80).otherwise(0) - F.when(F.element_at(recent, -1) == 0, 45).otherwise(0)
    return F.when(n == 0, F.lit(0.0)).otherwise(score)


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def last_n(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


@F.pandas_udf(StringType())
def canonical_digest(documents: pd.Series) -> pd.Series:
    """SHA-256 of JSON text re-written with sorted keys, no spaces and unescaped letters."""

    def digest(text: str | None) -> str | None:
        if text is None:
            return None
        shown = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(shown.encode()).hexdigest()

    return documents.map(digest)
