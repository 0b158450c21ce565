"""Centroid clustering of integer vectors with Elkan's bounds.

A table holds, for each vector, its cluster, an upper bound of the distance to that cluster's
centroid and a lower bound of the distance to each centroid. A round moves the bounds by how far
the centroids moved, and calculates only the distances that bounds and the distances between
centroids leave open. Bounds are rounded away from the truth and only strictly larger distances
are pruned, so every tie is decided by exact integers, as without bounds. Spark deals the vectors
and sums them by cluster; what reaches the driver is ``k`` centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import discard, released, saved, stored, table

K, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
LARGEST = 1 << 26  # of a component: 64 squared differences then fit a long
SLACK = 2.0**-48  # more than the rounding of a square root, a sum and a product
SLICE = 8192  # vectors at a time


def quantised(vectors: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(id, q array<int>)`` of the vectors with exactly ``dims`` finite components."""
    finite = F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = vectors.where((F.size(vec_col) == dims) & finite).select(F.col(id_col).alias("id"), F.transform(vec_col, lambda v: F.floor(v.cast("double") * scale)).alias("q"))
    fits = F.forall("q", lambda v: v.between(-LARGEST, LARGEST))
    return whole.select("id", F.when(fits, F.col("q")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).cast("array<int>").alias("q"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of ``x`` and ``y``."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


class Round:
    """One assignment to ``centres``; ``moved`` holds how far each is from where the bounds were taken."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centres, self.k = centres, len(centres)
        self.moved = np.zeros(self.k) if before is None else above(squared(centres, before))
        apart = np.stack([below(squared(centres, c[None, :])) for c in centres]) / 2
        self.apart = apart  # half the distance between two centroids, rounded down
        self.clear = np.where(np.eye(self.k, dtype=bool), np.inf, apart).min(axis=1)
        self.calculated = 0

    def _exact(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        self.calculated += len(x)
        return squared(x, c)

    def fresh(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of vectors never assigned: the first centroid, nothing known."""
        return np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), self.k))

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        upper = (upper + self.moved[a]) * (1 + SLACK)
        lower = np.maximum((lower - self.moved) * (1 - SLACK), 0)
        a = a.copy()
        rows = np.flatnonzero(~(upper < self.clear[a]))
        best = self._exact(x[rows], self.centres[a[rows]])
        upper[rows], lower[rows, a[rows]] = above(best), below(best)
        for c in range(self.k):
            here, most = a[rows], upper[rows]
            at = np.flatnonzero((here != c) & (lower[rows, c] <= most) & (self.apart[here, c] <= most))
            if not len(at):
                continue
            some = rows[at]
            d2 = self._exact(x[some], self.centres[c][None, :])
            lower[some, c] = below(d2)
            wins = (d2 < best[at]) | ((d2 == best[at]) & (c < a[some]))
            a[some[wins]], best[at[wins]], upper[some[wins]] = c, d2[wins], above(d2[wins])
        return a, upper, lower


def _floats_below(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.ravel(), kind))


def _step(centres: np.ndarray, before: np.ndarray | None, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Round(centres, before)
        k, dims = centres.shape
        for batch in _slices(batches):
            x = _matrix(batch.column(1), dims, np.int64)
            held = now.fresh(x) if before is None else (batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy(), _matrix(batch.column(4), k, np.float64))
            a, upper, lower = now.assign(x, *held)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int32()), pa.array(squared(x, centres[a]))], ["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.int32()), pa.array(upper), _lists(_floats_below(lower), pa.float32())], ["id", "q", "cluster", "upper", "lower"])

    return released(run)


def seeds(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest hash; a null id is hashed as empty, equal hashes are ordered by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def moved(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Each centroid as the exact floor of its vectors' mean; one without vectors stays."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("q")[i].cast("long")) for i in range(centres.shape[1])]).alias("sums")).collect()
    out = centres.copy()
    for r in sums:  # at most k rows
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance)`` of every kept vector, and the centroids.

    Vectors that are null, of another length or hold a null or non-finite component are left out;
    a component beyond 2^26 after scaling is an error. Rows that repeat an id are each kept and
    assigned. With fewer than ``k`` kept vectors each is a seed; with none the result is empty.
    Other columns do not matter.
    """
    spark = vectors.sparkSession
    kept, path = stored(quantised(vectors, id_col, vec_col, dims, scale))
    kind = kept.schema["id"].dataType.simpleString()
    centres, before, state = seeds(kept, k, seed), None, kept
    if not len(centres):
        return kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centres.reshape(0, dims)
    for _ in range(rounds):
        old = path
        state, path = stored(state.mapInArrow(_step(centres, before, last=False), f"id {kind}, q array<int>, cluster int, upper double, lower array<float>"))
        discard(spark, old)
        before, centres = centres, moved(state, centres)
    done = saved(state.mapInArrow(_step(centres, before, last=True), f"id {kind}, cluster int, distance long"))
    discard(spark, path)
    return done, centres


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, centres = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    sums = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    facts = spark.createDataFrame(
        [(c, d, sum(sums.values()), digests[c]) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return done.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same by all distances, a pair of subqueries a round."""
    number = f"""row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1"""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
 FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT c, q FROM (SELECT {number} AS c, q FROM kept) WHERE c < {k})""",
    ]
    near = """SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (
 SELECT r, c, list_sum(list_transform(list_zip(kept.q, c{i}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}) GROUP BY r"""
    mean = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT)"
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY j) AS q FROM (
 SELECT c, j, {mean} AS m FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i} JOIN kept USING (r)) GROUP BY c, j) GROUP BY c) m USING (c))""")
    parts.append(f"last AS MATERIALIZED ({near.format(i=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(list_aggregate(c{rounds}.q, 'string_agg', ',')) AS centroid_sha256
FROM last JOIN kept USING (r) JOIN c{rounds} USING (c)"""


OP13_SQL = sql()
