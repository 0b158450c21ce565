"""Helpers shared by the corpus operators: inputs, held-out rows, lineage cuts, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts`` (a null id falls in no fold)."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(parts)


_own: list[str] = []

PART = 50_000  # rows of a short table that a task reads
FEW = 250_000  # edges whose smallest neighbours are broadcast


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder. Where it is unset, a
    session on one machine, as in tests, gets a temporary folder; one on a cluster must set it."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.match(r"local(\[|$)", spark.sparkContext.master):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lanewise-"))
        return _own[0]
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it without its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def short(df: DataFrame) -> tuple[DataFrame, int]:
    """Like ``cut``, and how many rows it has; few rows are read by few tasks afterwards. The driver
    remembers every task, so that steps of many stages must not take one for each of many empty parts."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    n = seen.get["n"]
    return done.coalesce(tasks_for(df.sparkSession, n)), n


def tasks_for(spark: SparkSession, rows: int) -> int:
    """A task for each core, or for each ``PART`` of more rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like ``cut``, as a compressed table, and where it is."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table: for wide or many rows."""
    return stored(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a ``stored`` table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


Batches = Iterator[pa.RecordBatch]


def released(each: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``each`` for ``mapInArrow``; a worker gives free memory back after its task, since it lives on
    beside the executor's later stages."""

    def run(batches: Batches) -> Batches:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def beside(rows: DataFrame, small: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Inner join; ``small`` is broadcast only if a count shows at most ``most`` rows of it."""
    return rows.join(F.broadcast(small) if small.count() <= most else small, key)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``, root the smallest id.

    Alternating large-star and small-star rounds: every round re-hangs edges on the smallest
    neighbour seen, so the edge count never grows and a chain of length n ends in about
    log n rounds. A node's neighbours are reduced with ``min`` (partial aggregates), never
    collected. The minima of at most ``FEW`` edges are broadcast instead of shuffling the edges. Nodes without an edge are not returned; an empty input gives no rows. Raises if
    ``max_rounds`` do not suffice rather than returning a partial answer.
    """
    pairs, n = short(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few = n <= FEW
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(F.broadcast(low) if few else low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large if few else large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(F.broadcast(low) if few else low, "u")
        hung = (
            hung.select("u", F.col("m").alias("v"))
            .unionByName(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        pairs = cut(hung.coalesce(tasks_for(edges.sparkSession, n)) if few else hung)
        now = pairs.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum((F.col("v") % 1000003)), F.lit(0))).first()
        if now == before:
            return (
                pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
                .unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
