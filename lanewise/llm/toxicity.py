"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (learned stems), threat, target, negation, report, clause end, other.
Five small transducers read the symbols of a clause. The insult and the threat one emit a match at
their words; the threat one also waits ``REACH`` symbols for an addressed person. The negation one
remembers a negation for ``REACH`` symbols, the reported-speech one a reporting verb or an open
quotation, the target one an addressed person anywhere in the clause. Their product is one table of
states (``compose``), built at import. Scores come from matched clauses: each match, insult or threat,
falls in a class (plain, aimed, negated, reported) and each class has its own learned weight.

The lexicon is learned from labelled rows: prefixes of 4 to 8 letters and whole short words, weighed
by class log-odds over all labelled rows; a word takes the weight of its longest known prefix, so a
harmless long form beats its stem. Every key of ``MIN_ROWS`` toxic rows is counted in all clean rows;
of the keys, those that say anything are told to the tasks: the toxic ones and the longer forms of
those, ``LEXICON`` of them at most, the best evidence first. A threat word weighs 1 unless the labels
say more. Class weights are a logistic
fit on at most ``FIT_ROWS`` labelled rows, each scored with a lexicon learned from the other half.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import beside, cut, fold, table

FIT_ROWS = 20_000
LEXICON = 150_000  # keys of the fitted model
MIN_ROWS = 3
MAP_BITS = 1 << 26  # 8 MB of bitmap: the broadcast's bound at any corpus size
SURE = 1.5  # standard errors that a key's toxic rows exceed its share of the clean ones by
MIN_WEIGHT = 1.2
REACH = 3
REMEMBERED = 400_000
POSITIVE = 3.0  # weight of a toxic row against a clean one: a miss costs more than a false alarm
CLASSES = ("plain", "aimed", "negated", "reported")

# fixed values: closed word classes in the corpus languages
TARGETS = "you your yours yourself they them their people du dich dir ihr euch sie tu toi vous ils elles tú usted ustedes ellos vosotros".split()
NEGATIONS = "not no never nobody nor nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say told wrote called claimed quoted sagte sagt schrieb nannte dit disait écrit dijo dice escribió".split()
THREATS = "kill hurt destroy burn beat töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
SYMBOLS = {w: s for s, words in (("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("T", THREATS)) for w in words} | {q: "Q" for q in '"“”„«»'}
TOKENS = re.compile(r"[^\W_]+|[.!?;\n\"“”„«»]")
ENDS = frozenset(".!?;\n")

State = tuple[int, ...]
Machine = Callable[[int, str], int]


def _negation(state: int, symbol: str) -> int:
    return REACH if symbol == "N" else max(0, state - 1)


def _report(state: int, symbol: str) -> int:
    return state ^ 2 if symbol == "Q" else state | 1 if symbol == "R" else state


def _target(state: int, symbol: str) -> int:
    return 1 if symbol == "P" else state


def _insult(state: int, symbol: str) -> int:
    return 1 if symbol == "I" else state


def _threat(state: int, symbol: str) -> int:
    """How long a threat still waits for its target; one that met it stays at ``REACH + 1``."""
    if state > REACH or state and symbol == "P":
        return REACH + 1
    return REACH if symbol == "T" else max(0, state - 1)


def compose(machines: tuple[Machine, ...], alphabet: str) -> dict[tuple[State, str], State]:
    """Table of the machines' product over ``alphabet``, of the states reached from all zeros."""
    start: State = tuple(0 for _ in machines)
    table, waiting = {}, [start]
    while waiting:
        state = waiting.pop()
        for symbol in alphabet:
            after = tuple(m(s, symbol) for m, s in zip(machines, state, strict=True))
            table[state, symbol] = after
            if (after, alphabet[0]) not in table and after not in waiting:
                waiting.append(after)
    return table


GRAMMAR = compose((_negation, _report, _target, _insult, _threat), "IPNRTQO")
START: State = (0, 0, 0, 0, 0)


def clause(symbols: list[str], weights: list[float]) -> list[tuple[int, float]]:
    """``(class, weight)`` of every match of one clause: 0 to 3 for insults, 4 to 7 for threats, each
    plain, aimed, negated, reported. A threat is aimed at a target that it meets, or that an insult of
    the same clause is aimed at."""
    state, met = START, []
    for symbol, weight in zip(symbols, weights, strict=True):
        if symbol in "IT":
            met.append((symbol, state[0] > 0, state[1] > 0, weight))
        state = GRAMMAR[state, symbol]
    aimed = {"I": state[2] > 0, "T": state[4] > REACH or state[2] > 0 and state[3] > 0}
    return [(4 * (s == "T") + (3 if reported else 2 if negated else 1 if aimed[s] else 0), w) for s, negated, reported, w in met if w > 0]


def stems(word: str) -> list[str]:
    """The word's keys, the longest first."""
    whole = [word + "$"] if 3 <= len(word) <= 12 else []
    return whole + [word[:k] for k in range(min(8, len(word)), 3, -1)]


class Scanner:
    """Features of texts under one lexicon; remembers words' weights."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        for key in stems(word):
            if (w := self.lexicon.get(key)) is not None:
                return w if w >= MIN_WEIGHT else 0.0
        return 0.0

    def _said(self, token: str) -> float:
        symbol = SYMBOLS.get(token)
        if symbol == "T":
            return max(1.0, self.weight(token))
        return 0.0 if symbol or token in ENDS else self.weight(token)

    def features(self, text: str) -> list[float]:
        tokens = TOKENS.findall(text.lower())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for t in [t for t in set(tokens) if t not in known]:
            known[t] = self._said(t)
        hits = [i for i, t in enumerate(tokens) if known[t] > 0]
        sums, best, at, seen = [0.0] * KINDS, 0.0, -1, set()
        ends = [i for i, t in enumerate(tokens) if t in ENDS] if hits else []
        for i in hits:
            if i < at:
                continue  # in the clause just read
            k = bisect.bisect_left(ends, i)
            first, at = ends[k - 1] + 1 if k else 0, ends[k] if k < len(ends) else len(tokens)
            words = tokens[first:at]
            weights = [known[w] for w in words]
            matches = clause([SYMBOLS.get(w, "I" if x > 0 else "O") for w, x in zip(words, weights, strict=True)], weights)
            for kind, w in matches:
                sums[kind] += w
            best = max(best, sum(w for kind, w in matches if kind < 4))
            seen.update(w for w, x in zip(words, weights, strict=True) if x > 0 and w not in SYMBOLS)
        total = sum(sums[:4])
        dense, forms = math.log1p(100 * total / (len(tokens) + 10)), math.log1p(len(seen))
        return [*(math.log1p(s) for s in sums), math.log1p(best), dense, forms, dense * forms, math.log1p(len(tokens))]


KINDS = 8
WIDTH = KINDS + 5


def _keys(batches: Iterator[pa.RecordBatch], wanted: tuple[np.ndarray, int] | None) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, toxic, half, n)``: in how many texts of each label and half each key stands; with
    ``wanted`` only keys whose hash is in that bitmap."""
    counts: dict[tuple[str, int, int], int] = {}
    known: dict[str, list[str]] = {}

    bitmap, mask = (wanted[0].tobytes(), wanted[1]) if wanted else (b"", 0)
    digest = xxhash.xxh64_intdigest

    def asked(key: str) -> int:
        slot = digest(key.encode(), 42) & mask
        return bitmap[slot >> 3] >> (slot & 7) & 1

    def asked_of(word: str) -> list[str]:
        """The word's keys in the bitmap; where a prefix stands in too few texts, longer ones do too."""
        found, last = [], min(8, len(word))
        for k in range(4, last + 1):
            if not asked(word[:k]):
                return found
            found.append(word[:k])
        return [*found, word + "$"] if len(word) <= 12 and asked(word + "$") else found

    for batch in batches:
        for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(known) > REMEMBERED:
                known.clear()
            words = {w for w in set(TOKENS.findall((text or "").lower())) if len(w) > 2}
            for w in words.difference(known):
                known[w] = asked_of(w) if wanted else stems(w)
            for k in {k for w in words for k in known[w]}:
                counts[k, toxic, half] = counts.get((k, toxic, half), 0) + 1
    if counts:
        key, toxic, half = zip(*counts, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(toxic, pa.int32()), pa.array(half, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["key", "toxic", "half", "n"])


def _count(rows: DataFrame, wanted: tuple[np.ndarray, int] | None) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(wanted)
    return rows.mapInArrow(lambda b: _keys(b, given.value), "key string, toxic int, half int, n long").groupBy("key", "toxic", "half").agg(F.sum("n").alias("n"))


def _bitmap(keys: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the keys' hashes, ``MAP_BITS`` at most, and the mask that makes a hash a place in them."""
    bits = min(MAP_BITS, max(1 << 18, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64("key"), F.lit(bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:  # at most MAP_BITS / 32,768 rows
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out, bits - 1


def _telling(found: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
    """The keys of ``found(key, n00, n01, n10, n11)`` that are toxic in some lexicon, of one half or both,
    and those of which a toxic key is a prefix, with their evidence: how sure the toxic one is."""
    sure = []
    for halves in ([0], [1], [0, 1]):
        n1, n0 = (sum(sizes.get((c, h), 0) for h in halves) for c in (1, 0))
        c1, c0 = (sum((F.col(f"n{c}{h}") for h in halves), F.lit(0)) for c in (1, 0))
        due = (c0 + 1) / (n0 + 2) * n1
        above = (c1 - due) / F.sqrt(due + 1)
        heavy = F.log((c1 + 0.3) / (n1 + 0.6) * (n0 + 2) / (c0 + 1)) >= MIN_WEIGHT - 1e-9
        sure.append(F.when((above >= SURE - 1e-9) & heavy & ((c1 >= 2) | (c0 >= 2)), above))
    judged = cut(found.withColumn("evidence", F.greatest(*sure)))
    toxic = judged.where("evidence IS NOT NULL")
    letters = F.rtrim(F.col("key"), F.lit("$"))
    last = F.least(F.lit(8), F.length(letters) - F.when(F.endswith("key", F.lit("$")), 0).otherwise(1))
    starts = judged.where("evidence IS NULL").withColumn("to", last).where("to >= 4").select("key", F.explode(F.expr("transform(sequence(4, to), n -> left(key, n))")).alias("stem"))
    longer = starts.join(toxic.select(F.col("key").alias("stem"), "evidence"), "stem").groupBy("key").agg(F.max("evidence").alias("evidence"))
    return judged.drop("evidence").join(toxic.select("key", "evidence").unionByName(longer), "key")


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Lexicon and weights from labelled rows; rows without a label do not count."""
    half = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("half")), F.lit(2)).cast("int")
    given = rows.where(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), half.alias("half"))
    sizes = {(r["toxic"], r["half"]): r["n"] for r in given.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    toxic = cut(_count(given.where("toxic = 1"), None))
    often = cut(toxic.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_ROWS).select("key"))
    clean = _count(given.where("toxic = 0"), _bitmap(often))
    cells = [F.coalesce(F.sum(F.when((F.col("toxic") == c) & (F.col("half") == h), F.col("n"))), F.lit(0)).alias(f"n{c}{h}") for c in (0, 1) for h in (0, 1)]
    counted = toxic.unionByName(clean).join(often, "key", "left_semi").groupBy("key").agg(*cells)
    found = _telling(counted, sizes).orderBy(F.desc("evidence"), "key").limit(LEXICON).toArrow()  # at most LEXICON rows
    names = found.column("key").to_pylist()
    counts = np.array([found.column(f"n{c}{h}").to_numpy() for c in (0, 1) for h in (0, 1)], float).reshape(2, 2, -1)

    def lexicon(halves: list[int]) -> dict[str, float]:
        n1, n0 = (sum(sizes.get((c, h), 0) for h in halves) for c in (1, 0))
        c1, c0 = counts[1, halves].sum(0), counts[0, halves].sum(0)
        weights = np.log((c1 + 0.3) / (n1 + 0.6) * (n0 + 2) / (c0 + 1))
        due = (c0 + 1) / (n0 + 2) * n1  # toxic rows that an innocent key would have
        sure = (c1 - due) / np.sqrt(due + 1) >= SURE
        weights = np.where(sure, weights, np.minimum(weights, 0))
        return {names[k]: float(weights[k]) for k in np.flatnonzero((c1 >= 2) | (c0 >= 2))}

    crossed = rows.sparkSession.sparkContext.broadcast([lexicon([1]), lexicon([0])])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(x) for x in crossed.value]
        for batch in batches:
            found = [scanners[h].features(t or "") for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(found, pa.list_(pa.float64()))], ["toxic", "h", "x"])

    # a bounded sample, the same for the same rows: the smallest hashes of the ids
    sample = rows.where(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), half.alias("half"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    share = min(1.0, FIT_ROWS / max(1, sum(sizes.values())))
    sample = sample.where(F.col("h") <= F.lit(min(2**63 - 1, int((2 * share - 1) * 2**63)))).select("text", "toxic", "half", "h")
    fit = sample.mapInArrow(measure, "toxic int, h long, x array<double>").orderBy("h", "toxic", "x").limit(FIT_ROWS).toArrow()
    x = np.array(fit.column("x").to_pylist(), float).reshape(-1, WIDTH)
    y = fit.column("toxic").to_numpy().astype(float)
    return {"lexicon": lexicon([0, 1]), "weights": logistic(x, y)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Ridge logistic weights, the last one the intercept; all zero without rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    cost = np.where(y > 0, POSITIVE, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (cost * p * (1 - p) + 1e-9)) @ x / len(x) + ridge * np.eye(len(w)), x.T @ (cost * (y - p)) / len(x) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``score`` in 0 to 1 and ``predicted``.

    Null and empty texts are scored as texts without a match. Without training rows every score is
    0.5. Other columns do not matter; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON keys

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, w = Scanner(shared.value["lexicon"]), shared.value["weights"]
        for batch in batches:
            x = np.array([scanner.features(t or "") for t in batch.column(1).to_pylist()], float).reshape(-1, WIDTH)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(each, f"`{id_col}` {kind}, score double, predicted int")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 5) != 0)
    model = learn(beside(docs, labels, "doc_id"))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
