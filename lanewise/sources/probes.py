"""Measurements behind an interface: recorded rows stand in for the network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "url string, ok boolean, height int, stream_mbps double, segment_mbps double, manifest_s double, error string"


class Prober(Protocol):
    """Measures one URL; runs inside tasks, so it must be picklable."""

    def __call__(self, url: str) -> dict: ...


def measure(routes: DataFrame, url: str, prober: Prober) -> DataFrame:
    """One result row per different URL; a prober's exception is a row with its name."""
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for address in frame[url]:
                try:
                    rows.append({"url": address, "ok": True, "error": None} | prober(address))
                except Exception as e:  # one route's failure is a result
                    rows.append({"url": address, "ok": False, "error": type(e).__name__})
            yield pd.DataFrame(rows, columns=names)

    return routes.select(url).distinct().mapInPandas(run, RESULT)


def recorded(routes: DataFrame, url: str, log: DataFrame) -> DataFrame:
    """Results of a recorded log for these routes; a route without one is a failed row."""
    found = routes.select(F.col(url).alias("url")).distinct().join(log, "url", "left")
    return found.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("error", F.when(F.col("ok"), F.col("error")).otherwise(F.coalesce("error", F.lit("not_recorded"))))
