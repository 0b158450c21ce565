"""Near copies by their shingles: every pair of texts whose Jaccard likeness is at least four fifths.

First come the candidates of SimHash: texts with one fingerprint, and those that the tiled comparison
links, checked exactly. Their groups are settled; what fingerprints miss is found by shingles.
Texts are sets of hashed runs of ``SHINGLE`` words. Under any one order of all shingles, two sets that
alike share one of the first ``n - ceil(4 n / 5) + 1`` shingles of each (prefix filter), so only texts
that meet there are compared, and those comparisons are exact: no pair is lost. The order puts
shingles that a sample shows to be common last; it decides the cost, never the result. Texts that
meet are first compared with the text of their size class in their group (two rows of classes of a
quarter, half a class apart) that has the fewest uncommon shingles: of copies edited in different
places, the one that is like most of the others. Groups that this links to one component are done; in
the others every pair of different components is compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm import simhash
from lanewise.llm.common import components, cut, discard, released, short, stored

SHINGLE = 5
SEED = 42
SAMPLE = 8  # one text of so many is looked at for common shingles
COMMON = 4  # a shingle in so many of them is common
BUCKETS = 256  # shingle counts by leading bits, whose minima bound what two sets share
TOGETHER = 200  # texts whose shingles are held at once
MOST_COMMON = 500_000  # the most that are told to the executors; others stand in hash order


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes: ASCII lower case, words between white space; a shorter
    text is one shingle, also without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8").view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    one = xxhash.xxh64_intdigest
    hashes = [one(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, "<u8").view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles in the common order, and how many of all are not common; ``common`` is
    sorted, ``place`` its order."""
    n, rare = len(hashes) - (4 * len(hashes) + 4) // 5 + 1, len(hashes)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[at] == hashes
        if late.any():
            rare -= int(late.sum())
            hashes = np.concatenate([hashes[~late], hashes[late][np.argsort(place[at[late]])]])
    return hashes[:n], rare


def _rows(texts: DataFrame, common: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``(key, n, r, i, h)``: each text's shingles, or with ``common`` its prefix only, and their places; n
    counts all its shingles, r those of them that are not common."""
    told = texts.sparkSession.sparkContext.broadcast(common)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                found = [(s, len(s)) if told.value is None else prefix(s, *told.value) for s in sets]
                shown, lengths = [s for s, _ in found], [len(s) for s, _ in found]
                keys, sizes, rare = part.column(0).to_numpy(), np.array([len(s) for s in sets], np.int32), np.array([r for _, r in found], np.int32)
                place = np.concatenate([*(np.arange(k, dtype=np.int32) for k in lengths), np.zeros(0, np.int32)])
                columns = [*(np.repeat(x, lengths) for x in (keys, sizes, rare)), place, np.concatenate([*shown, np.zeros(0, np.int64)])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "n", "r", "i", "h"])

    return texts.mapInArrow(released(each), "key long, n int, r int, i int, h long")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles common in a sample, sorted, and their places from rare to common."""
    seen = _rows(texts.where(F.pmod(F.col("key"), F.lit(SAMPLE)) == 0), None).groupBy("h").count()
    found = seen.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, count = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "count"))
    order = np.argsort(h)
    place = np.empty(len(h), np.int64)
    place[np.lexsort((h, count))] = np.arange(len(h))
    return h[order], place[order]


def _may_be_alike(n: str, i: str, m: str, j: str) -> Column:
    """Whether two sets of n and m shingles can be alike whose first common one stands at places i and j."""
    return 9 * F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= 4 * (F.col(n) + F.col(m))


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose texts' Jaccard likeness is at least four fifths.

    First by how many shingles start with the same bits, which bounds what two sets share; whole sets
    are made for the texts of pairs that this leaves, and deleted afterwards.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                found = [shingles(t) for t in part.column(1).to_pylist()]
                tops = [np.bincount((s.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=BUCKETS) for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int32()), pa.array(tops, pa.list_(pa.int16()))], ["key", "n", "c"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["key", "s"])

    def of(pairs: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: str) -> tuple[DataFrame, str]:
        wanted = _small(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        return stored(texts.join(wanted, "key").select("key", "text").mapInArrow(released(each), shape))

    side = lambda told, x: told.select(*[F.col(c).alias(x if c == "key" else c + x) for c in told.columns])
    pairs, _ = short(pairs)
    told, path = of(pairs, counts, "key long, n int, c array<smallint>")
    most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda x, y: x + y)
    likely, _ = short(pairs.join(side(told, "a"), "a").join(side(told, "b"), "b").where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"))
    discard(texts.sparkSession, path)
    told, path = of(likely, sets, "key long, s array<bigint>")
    both = likely.join(side(told, "a"), "a").join(side(told, "b"), "b")
    alike, _ = short(both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b").distinct())
    discard(texts.sparkSession, path)
    return alike


def _small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, broadcast if it has at most ``most`` rows."""
    df, n = short(df)
    return F.broadcast(df) if n <= most else df


def _tiled(texts: DataFrame) -> DataFrame:
    """Pairs of keys that SimHash's tiles link, each fingerprint's texts to its smallest key."""
    fps = cut(simhash.fingerprints(texts, "key", "text"))
    points, _ = short(fps.groupBy("fp").agg(F.min("key").alias("id")))
    equal = fps.join(points, "fp").where("id <> key").select(F.col("id").alias("a"), F.col("key").alias("b"))
    return equal.unionByName(simhash.links(points).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def linked(texts: DataFrame) -> DataFrame:
    """Components ``(node, root)`` of ``texts(key long, text)`` over all pairs of near copies; texts
    without one are not returned."""
    tiled = _alike(_tiled(texts), texts)
    at = Window.partitionBy("h")
    size = F.log(F.col("n").cast("double")) / math.log(1.25)
    rows = _rows(texts, _common(texts)).withColumns({"low": F.floor(size).cast("int"), "high": F.floor(size + 0.5).cast("int")})
    least = F.min(F.struct("r", "n", "key"))
    met = rows.withColumns({"some": F.min("key").over(at), "top": F.max("key").over(at)}).where("some < top")  # one shuffle, by h, for all three windows
    met = met.withColumns({"p": least.over(Window.partitionBy("h", "low"))["key"], "q": least.over(Window.partitionBy("h", "high"))["key"]})
    met, path = stored(met.select("h", "key", "n", "i", "p", "q"))
    near = met.select(F.explode(F.array_distinct(F.array("p", "q"))).alias("pivot"), "key").where("pivot <> key")
    pivots = near.select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")).distinct()
    first = tiled.unionByName(_alike(pivots.join(_small(tiled), ["a", "b"], "left_anti"), texts))
    roots = components(first)
    placed = met.join(_small(roots), met["key"] == F.col("node"), "left").select("h", "key", "n", "i", F.coalesce("root", "key").alias("root"))
    still = placed.withColumns({"low": F.min("root").over(at), "high": F.max("root").over(at)}).where("low < high").select("h", "key", "n", "i", "root")
    still = cut(still)
    discard(texts.sparkSession, path)
    other = still.select("h", F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("root").alias("root2"))
    pairs = still.join(other, "h").where("root < root2").where(_may_be_alike("n", "i", "n2", "i2"))
    second = _alike(pairs.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct(), texts)
    return components(first.unionByName(second))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near copies one row: that with the smallest id, nulls last, then by text hash.

    Groups are connected over Jaccard likeness of at least four fifths on ``SHINGLE`` words; null
    texts count as empty, and texts without a word are alike. Rows are told apart by a 64-bit hash
    of id and text, so null and repeated ids lose nothing; of rows that repeat both, one stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_key", key)
    texts = keyed.select(F.col("_key").alias("key"), text.alias("text"))
    found = linked(texts)
    mine = keyed.select("_key", F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.xxhash64(text), "_key").alias("_rank"))
    ranked = cut(mine.join(_small(found), F.col("_key") == F.col("node")).select("root", "_key", "_rank"))
    best = ranked.groupBy("root").agg(F.min("_rank")["_key"].alias("_best"))
    gone = _small(ranked.join(best, "root").where("_key <> _best").select("_key").distinct())
    twice = _small(keyed.groupBy("_key").count().where("count > 1").select("_key"))
    left = keyed.join(gone, "_key", "left_anti")
    once = left.join(twice, "_key", "left_anti").select(*names)
    return once.unionByName(left.join(twice, "_key", "left_semi").dropDuplicates(["_key"]).select(*names))
