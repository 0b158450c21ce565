"""SimHash near-duplicates by exact tiled comparison.

Distinct fingerprints are laid in tiles by the population counts of their ``PARTS`` parts. The
counts of two fingerprints differ, summed over the parts, by no more than their Hamming distance,
so only tile pairs whose counts differ by at most the radius can hold a link; the others are
skipped. A tile is split into blocks of about ``BLOCK`` fingerprints, and its neighbours' rows
into groups of about ``GUESTS``, so one task's group stays small however many fingerprints share a
tile. Inside a task numpy compares block against block with exclusive-or and bit counts and
returns a spanning forest of the links found (at most one edge a fingerprint), never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import components, cut, table

SHINGLE = 3
RADIUS = 2
SEED = 42
PARTS = 4
BLOCK = 8192
GUESTS = 65536
ROWS, COLS = 256, 4096


def fingerprint(text: str | None) -> int:
    """64-bit SimHash: ASCII lower case, words between white space, shingles with repeats; a bit is
    set where more than half of the shingles' XXH64 values have it. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; fp is the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, fp long")


def _counts(fp: Column, parts: int) -> list[Column]:
    width = 64 // parts
    mask = F.lit((1 << width) - 1)
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(mask)) for i in range(parts)]


def _steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Tile offsets within the radius, one of each opposite pair, without zero."""
    near = (d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if 0 < sum(map(abs, d)) <= radius)
    return [d for d in near if d > tuple([0] * parts)]


def forest(home: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as positions in home + guest, of the links home-home and home-guest."""
    every = np.concatenate([home, guest])
    root = np.arange(len(every))
    touched = False
    for a in range(0, len(home), ROWS):
        left = every[a : a + ROWS]
        for b in range(a, len(every), COLS):
            right = every[b : b + COLS]
            close = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
            if b == a:
                np.fill_diagonal(close, False)
            if not close.any():
                continue
            touched = True
            i, j = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
            close = close[np.ix_(i, j)]
            li, lj = root[a + i], root[b + j]
            while True:
                ni = np.minimum(li, np.where(close, lj[None, :], len(every)).min(1))
                nj = np.minimum(lj, np.where(close, ni[:, None], len(every)).min(0))
                if (ni == li).all() and (nj == lj).all():
                    break
                li, lj = ni, nj
            _merge(root, np.concatenate([root[a + i], root[b + j]]), np.concatenate([li, lj]))
    if not touched:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hung = np.flatnonzero(root != np.arange(len(every)))
    return hung, root[hung]


def _merge(root: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Join the components of ``old[k]`` and ``new[k]`` for every k; roots stay the smallest."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            x = y
        return x

    for x, y in {(x, y) for x, y in zip(old.tolist(), new.tolist(), strict=True) if x != y}:
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    if parent:
        moved = np.arange(len(root))
        keys = np.fromiter(parent, np.int64, len(parent))
        moved[keys] = [top(k) for k in parent]
        root[:] = moved[root]


def links(points: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """A spanning forest ``(a, b)`` of all links between the distinct fingerprints ``points(fp, id)``."""
    placed = points.select("fp", "id", F.array(*_counts(F.col("fp"), parts)).alias("tile"))
    sizes = placed.groupBy("tile").agg(F.count("*").alias("n"))
    reach = F.explode(F.array(*[F.array(*[F.lit(x) for x in d]) for d in _steps(parts, radius)]))
    moved = lambda tile, step: F.zip_with(tile, step, lambda x, y: x + y)
    came = (
        sizes.select("tile", "n", reach.alias("step")).select(moved(F.col("tile"), F.col("step")).alias("tile"), "n")
        .groupBy("tile").agg(F.sum("n").alias("guests"))
    )
    # at most (64 / parts + 1) ** parts tiles: a fixed bound, 83,521 rows for four parts
    tiles = F.broadcast(
        sizes.join(came, "tile", "left").select(
            "tile",
            F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
            F.greatest(F.lit(1), F.ceil((F.coalesce("guests", F.lit(0)) + F.col("n")) / GUESTS)).cast("int").alias("groups"),
        )
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    group = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("groups"))
    home = placed.join(tiles, "tile")
    own = home.select("tile", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(True).alias("own"), "fp", "id")
    # guests: rows of neighbouring tiles, and of later blocks of the same tile
    beside = home.where("blocks > 1").select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), group.alias("group"), F.lit(False).alias("own"), "fp", "id", block.alias("mine")).where("block < mine").drop("mine")
    away = (
        placed.select("fp", "id", "tile", reach.alias("step")).select("fp", "id", moved(F.col("tile"), F.col("step")).alias("tile"))
        .join(tiles, "tile")
        .select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), group.alias("group"), F.lit(False).alias("own"), "fp", "id")
    )
    work = own.select("tile", F.col("block").cast("int"), F.col("group").cast("int"), "own", "fp", "id")
    for more in (beside, away):
        work = work.unionByName(more.select("tile", F.col("block").cast("int"), F.col("group").cast("int"), "own", "fp", "id"))

    def compare(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        ids = group.column("id").to_numpy()
        own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
        order = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
        a, b = forest(fps[own], fps[~own], radius) if own.any() else (order[:0], order[:0])
        return pa.table({"a": pa.array(ids[order[a]], pa.int64()), "b": pa.array(ids[order[b]], pa.int64())})

    return work.select(F.xxhash64(F.to_json(F.struct("tile"))).alias("tile"), "block", "group", "own", "fp", "id").groupBy("tile", "block", "group").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """One row per row of ``docs``: the id, ``fp`` (signed long) and ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest id
    reachable over links, itself included. Null and blank texts have fingerprint zero and link like
    any other. Rows with a null id take part with the smallest other id of their fingerprint, if
    any. Other columns do not matter; an empty table gives no rows.
    """
    fps = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col))
    points = cut(fps.groupBy("fp").agg(F.min(id_col).alias("id")))
    roots = components(links(points.where("id is not null"), radius, parts))
    label = points.join(roots, points["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(label, "fp").select(id_col, "fp", "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
