"""Quality by naive Bayes support vectors.

A text is the set of its n-grams' slots: words, pairs of neighbouring words, word shapes (case, closing signs, whether the word
repeats one of the last words) and pairs of shapes, each shape gram with the share of the text that it
fills, in powers of two. Class log-count ratios come from every labelled row, summed by slot over
``SLOTS`` slots, so the table that meets on the driver has a fixed size. Indicators scaled by the
ratios go into a linear hinge-loss model, fitted by dual coordinate descent on at most
``FIT_ROWS`` labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import beside, fold, table

SLOTS = 1 << 18
FIT_ROWS = 6000
SMOOTH = 1.0
COST = 1.0
ROUNDS = 30
REMEMBERED = 400_000
LOOKBACK = (1, 2, 3, 4)
ENDS = ".,;:!?#%&*$@|~^=_-+\"')]}<>"
SHAPES = 64  # of one word: 4 cases x 4 lengths x 4 ends


class Grams:
    """Slots of texts' n-grams; remembers words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _word(raw: bytes) -> int:
        """Hash of the lower-cased word above its shape."""
        word = raw.decode("utf-8", "replace")
        core = word.rstrip(ENDS)
        case = 3 if len(core) > 1 and core.isupper() else 2 if core[:1].isupper() else 1 if core.islower() else 0
        size = min(3, len(core) // 4)
        return zlib.crc32(word.lower().encode()) << 6 | case << 4 | size << 2 | min(3, len(word) - len(core))

    def slots(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(1, np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in [w for w in set(words) if w not in known]:
            known[w] = self._word(w)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        hashes, shape = codes >> 6, codes & 63
        back = np.zeros(len(words), np.int64)  # how far back the word stood last: 0 not near
        for k in LOOKBACK[::-1]:
            if len(words) > k:
                back[k:][hashes[k:] == hashes[:-k]] = k
        distinct = np.unique(hashes)
        grams = [
            _filled(shape * 8 + back, 1 << 10, 1),
            _filled(back, 8, 2),
            _filled((shape[:-1] * SHAPES + shape[1:]), SHAPES * SHAPES, 3),
            _filled(shape & 3, 4, 4),
            _filled(shape >> 4, 4, 5),
            _slot(np.array([int(32 * len(distinct) / len(words)) * 16 + len(words).bit_length()]), 6),
            _slot(distinct, 7),
            _slot(np.unique(hashes[:-1] * 31 + hashes[1:]), 8),
        ]
        return np.unique(np.concatenate([[0], *grams]))


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (values.astype(np.uint64) * np.uint64(16) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return 1 + ((x >> np.uint64(33)) % np.uint64(SLOTS - 1)).astype(np.int64)


def _filled(codes: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Slots of the codes present, each with every power of two that its share reaches."""
    counts = np.bincount(codes, minlength=size)
    present = np.flatnonzero(counts)
    share = counts[present] / max(1, len(codes))
    reached = [present[share >= 2.0**-k] * 8 + k for k in range(8)]
    return _slot(np.concatenate([*reached, present * 8 + 7]), kind)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, counts = Grams(), np.zeros((2, SLOTS), np.int64)
    for batch in batches:
        for text, label in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[label, grams.slots(text)] += 1
    label, slot = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[label, slot])], ["label", "slot", "n"])


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        found = [grams.slots(t).astype(np.int32) for t in _texts(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["label", "h", "slots"])


def descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, costs: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model on indicators scaled by ``ratio``, by dual
    coordinate descent: one dual variable a row, each solved in turn and clipped to its box."""
    weights = np.zeros(len(ratio))
    duals = np.zeros(len(rows))
    squares = np.array([max(1e-12, float((ratio[r] ** 2).sum())) for r in rows])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            scaled = ratio[rows[i]]
            slope = signs[i] * float(weights[rows[i]] @ scaled) - 1
            after = min(max(duals[i] - slope / squares[i], 0.0), costs[i])
            if (step := after - duals[i]) != 0:
                weights[rows[i]] += signs[i] * step * scaled
                duals[i] = after
                moved = max(moved, abs(step) * squares[i])
        if moved < 1e-3:
            break
    return weights


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """Weights by slot and the scale of margins, from labelled rows (others do not count)."""
    given = rows.where(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    tally = given.select("text", "label").mapInArrow(_tally, "label int, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, SLOTS))
    counts[tally.column("label").to_numpy(), tally.column("slot").to_numpy()] = tally.column("n").to_numpy()
    sizes = counts[:, 0].copy()  # slot 0 stands in every row
    share = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    ratio[counts.sum(0) < 3] = 0.0
    ratio[0] = 1.0  # the intercept
    if not sizes.all():
        return {"weights": np.zeros(SLOTS), "bias": 0.0 if not sizes.any() else 20.0 if sizes[1] else -20.0}
    # a bounded sample, the same for the same rows: the smallest hashes of the ids, by class
    parts = []
    for label in (0, 1):
        part = min(1.0, FIT_ROWS / 2 / sizes[label])
        sample = given.where((F.col("label") == label) & (F.col("h") <= F.lit(min(2**63 - 1, int((2 * part - 1) * 2**63))))).select("text", "label", "h")
        parts.append(sample)
    fit = parts[0].unionByName(parts[1]).mapInArrow(_present, "label int, h long, slots array<int>").orderBy("h", "label", "slots").limit(2 * FIT_ROWS).toArrow()
    labels = fit.column("label").to_numpy()
    found = [np.array(s, np.int64) for s in fit.column("slots").to_pylist()]
    costs = np.where(labels == 1, COST, COST * max(1.0, (labels == 1).sum() / max(1, (labels == 0).sum())) ** 0.5) / 100
    weights = descend(found, np.where(labels == 1, 1.0, -1.0), ratio, costs)
    return {"weights": weights * ratio, "bias": 0.0}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``score`` in 0 to 1 and ``predicted``.

    Null, empty and blank texts have the intercept's score. Without training rows every score is
    0.5; with one class only, all rows are of it. Other columns do not matter; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: SLOTS weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, weights, bias = Grams(), shared.value["weights"], shared.value["bias"]
        for batch in batches:
            margins = np.array([weights[grams.slots(t)].sum() + bias for t in _texts(batch.column(1))])
            p = 1 / (1 + np.exp(-np.clip(2 * margins, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, score double, predicted int")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 3) != 1)
    model = learn(beside(docs, labels, "doc_id"))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
