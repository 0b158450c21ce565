"""Language identification with bit-sliced Bloom filters over letter trigrams.

Training counts trigrams per language over every training text; a language "contains" a trigram
whose share of that language's trigrams is at least ``MIN_SHARE`` (so at most 1 / MIN_SHARE
trigrams a language, whatever the corpus) and at least ``RELATIVE`` of its largest share in any
language. All languages' Bloom filters lie in one array of words: bit L of a word is language L's
filter, so reading ``HASHES`` words and AND-ing them returns the set of all languages that contain
a trigram. A text's languages are the popcounts of its trigrams' sets, less the false positives
that each filter's fill makes likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import fold, released, table

SLOTS = 1 << 20
HASHES = 3
MIN_SHARE = 1e-5
RELATIVE = 0.15
CHUNK_CHARS = 1_000_000
MAX_LANGUAGES = 64
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of letter trigrams (the middle one a letter, other signs as one space), each code's
    text number, and for each text whether it has a letter."""
    low = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter((len(t) for t in low), np.int64, len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    owner = np.repeat(np.arange(len(low)), sizes)
    has = np.bincount(owner[letter], minlength=len(low)) > 0
    mid = np.flatnonzero(letter)  # never the first or last: every text has a space at both ends
    folded = np.where(letter, points, 32).astype(np.uint64)
    codes = folded[mid - 1] << np.uint64(42) | folded[mid] << np.uint64(21) | folded[mid + 1]
    return codes, owner[mid], has


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    """Slots of each code in the filters: bits of one multiplicative mix."""
    with np.errstate(over="ignore"):
        x = codes * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return [((x >> np.uint64(s)) & np.uint64(SLOTS - 1)).astype(np.int64) for s in (0, 21, 42)][:HASHES]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for a, b in _chunks(texts):
                codes, n = np.unique(trigrams(texts[a:b])[0], return_counts=True)
                if lang in held:
                    old, m = held[lang]
                    codes, at = np.unique(np.concatenate([old, codes]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([m, n]), len(codes)).astype(np.int64)
                held[lang] = codes, n
    for lang, (codes, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Filters from every row with text and language; the driver gets bounded tables only."""
    seen = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    counts = seen.mapInArrow(released(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"), "total").where(F.col("share") >= MIN_SHARE)
    grams = (
        shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share", "total")).alias("held"))
        .select("gram", F.transform(F.filter("held", lambda h: h["share"] >= RELATIVE * F.col("most")), lambda h: F.struct(h["lang"], h["total"])).alias("held"))
        .select("gram", F.explode("held").alias("h")).select("gram", F.col("h.lang").alias("lang"), F.col("h.total").alias("total"))
    ).toArrow()
    names, totals_by = grams.column("lang").to_pylist(), {}
    for lang, total in zip(names, grams.column("total").to_pylist(), strict=True):
        totals_by[lang] = total
    langs = sorted(totals_by)
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"a filter word holds {MAX_LANGUAGES} languages, not {len(langs)}")
    index = {lang: i for i, lang in enumerate(langs)}
    words = np.zeros(SLOTS, np.uint64)
    bits = np.uint64(1) << np.fromiter((index[x] for x in names), np.uint64, len(names))
    for slot in _slots(grams.column("gram").to_numpy().astype(np.uint64)):
        np.bitwise_or.at(words, slot, bits)
    fill = [float(np.count_nonzero(words >> np.uint64(i) & np.uint64(1))) / SLOTS for i in range(len(langs))]
    fallback = min(langs, key=lambda x: (-totals_by[x], x)) if langs else UNKNOWN
    return {"langs": langs, "words": words, "false": np.array([f**HASHES for f in fill]), "fallback": fallback}


def decide(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, words, false = model["langs"], model["words"], model["false"]
    preds, scores = [], []
    given = [t or "" for t in texts]
    for a, b in _chunks(given):
        codes, owner, has = trigrams(given[a:b])
        sets = np.full(len(codes), ~np.uint64(0))
        for slot in _slots(codes):
            sets &= words[slot]
        n = np.bincount(owner, minlength=b - a)
        counts = np.stack([np.bincount(owner[(sets >> np.uint64(i)) & np.uint64(1) == 1], minlength=b - a) for i in range(len(langs))], 1) if langs else np.zeros((b - a, 0))
        right = np.maximum(0.0, (counts - n[:, None] * false) / (1 - np.minimum(false, 0.999999))) if langs else counts
        total = right.sum(1)
        for i in range(b - a):
            if not has[i] or not langs:
                preds.append(UNKNOWN)
                scores.append(0.0)
            elif total[i] == 0:
                preds.append(model["fallback"])
                scores.append(0.0)
            else:
                k = int(np.argmax(right[i]))  # ties: the first in alphabetical order
                preds.append(langs[k])
                scores.append(float(right[i, k] / total[i]))
    return preds, scores


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred`` and ``score``.

    Null text, or text without a letter, is ``und`` with score 0; a text with letters none of
    whose trigrams is known gets the largest training language with score 0. Ties go to the first
    name. Without training rows all is ``und``. Other columns do not matter; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: SLOTS words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = decide(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(released(score), f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text has an identifiable language; ``und`` rows go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, _ = decide(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([p != UNKNOWN for p in preds], pa.bool_()))

    return docs.mapInArrow(released(keep), docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
