"""Packing into windows of tokens by non-negative least squares on the histogram of lengths.

Full windows of long documents stand alone. For what remains of each document, all combinations of
at most ``DEPTH`` lengths that fill a window exactly are enumerated, and the repeat counts of the
combinations are solved against the histogram by non-negative least squares, rounded, and held to
the lengths there are. Residual pieces are packed greedily: exact pairs and best fits first; those
that fill no window go end to end and are cut where a window is full, the very last at powers of
two, where no padding is due. The driver holds the histogram and the combinations, bounded by the
window; tokenising, ranking, placing and cutting run on Spark.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import Batches, beside, discard, released, saved, stored, table
from lanewise.llm.packing import LONGEST, WordIds, _complete, _use

CAPACITY = 1024
STEPS = 300
PARTS = 300_000  # remembered by a worker in a generation, of which there are two
TOGETHER = 4_000_000  # signs of text cut at a time
PLACED = "row long, at long, length long, sequence_id long, offset long, whole boolean"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkIds(WordIds):
    """Ids of texts by a byte-level tokenizer, part by part, with two generations of remembered parts.

    The tokenizer's splitter never goes on over a space after a sign that is not white space, and
    starts anew there; nor does it join a line feed to the next sign. So a text with no white space
    but single spaces and one or two line feeds is cut before each of them; one with other white
    space is cut before spaces only, and where that is not safe, or where it may hold special
    tokens, it is encoded whole. Many texts are cut together, and their chunks told apart, by numpy
    and Arrow. A chunk of Latin letters is one word to the splitter and goes straight to the model in
    its byte alphabet; a run of ``TAILS`` after it is a part of its own. Python meets each different
    part once for all the texts.
    """

    ODD = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
    RUNS = "  ", " \n", "\n\n\n", "\n\n "
    TANGLED = re.compile(r"\s (?:\s|\Z)| \n")
    LEAD = 1

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.feed = self._encode(["\n"])[0]

    @classmethod
    def uneven(cls, text: str) -> bool:
        """Whether ``text`` has other white space than single spaces and one or two line feeds, or ends in
        a line feed and more; sought sign by sign, which goes many times faster than a pattern."""
        return any(c in text for c in cls.RUNS) or any(c in text for c in cls.ODD) or text.endswith(("\n\n", "\n "))

    def straight(self, part: str) -> bytes | None:
        """A part of Latin letters starts with its space or line feed."""
        lead, letters = part[:1], part[1:]
        if lead not in (" ", "\n") or not letters.isalpha() or max(letters) >= self.LATIN:
            return None
        return self._letters(letters, self.alphabet[32]) if lead == " " else self.feed + self._letters(letters)

    def learn(self, parts: list[str]) -> list[bytes]:
        return super().learn(parts, PARTS)

    def _lowered(self, words: pa.Array) -> pa.Array:
        return words  # this tokenizer tells capitals apart

    def ids(self, texts: list[str]) -> list[bytes]:
        whole, even, first = [], [], []
        for i, t in enumerate(texts):
            if "<|" in t:
                whole.append(i)
            elif not self.uneven(t):
                even.append(i)
            elif not self.TANGLED.search(t):
                first.append(i)
            else:
                whole.append(i)
        out = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
        cut = even + first
        if not cut:
            return [out[i] for i in range(len(texts))]
        said = [b"\n" + texts[i].encode() for i in even] + [texts[i].encode() for i in first]
        ends = np.cumsum([len(t) for t in said])
        data = np.frombuffer(b"".join(said), np.uint8)
        begins = data == 32
        feeds = int(ends[len(even) - 1]) if even else 0
        begins[:feeds] |= data[:feeds] == 10
        begins[0] = True
        begins[ends[:-1]] = True
        bounds = np.append(np.flatnonzero(begins), len(data))
        starts, joined = self._spelt(pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)))
        at = starts[np.searchsorted(bounds, np.concatenate([[0], ends]))].tolist()
        skip = len(self.feed)
        for k, i in enumerate(cut):
            out[i] = bytes(joined[at[k] + (skip if k < len(even) else 0) : at[k + 1]])
        return [out[i] for i in range(len(texts))]


_tokenizers: dict[str, ChunkIds] = {}


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """``(id, row, start, length, ids_crc32, doc_tokens, ids)``: each text's ids and a closing 0, cut
    into full windows and a rest. ``row`` is unique; ``ids`` (little-endian) is null for full ones."""

    def cut_up(batches: Batches) -> Batches:
        chunks = _tokenizers.get(path)
        if chunks is None:
            chunks = _tokenizers[path] = ChunkIds(path)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = [t or "" for t in batch.column(1).cast(pa.string()).to_pylist()]
            start = 0
            while start < len(texts):
                end, size = start + 1, len(texts[start])
                while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                    size += len(texts[end])
                    end += 1
                where, numbers, rests = [], [], []
                for i, ids in enumerate(chunks.ids(texts[start:end]), start):
                    ids += b"\0\0\0\0"
                    for at in range(0, len(ids), 4 * capacity):
                        part = ids[at : at + 4 * capacity]
                        where.append(i)
                        numbers.append((row, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
                        rests.append(None if len(part) == 4 * capacity else part)
                        row += 1
                columns = np.array(numbers, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(np.ascontiguousarray(columns[:, k])) for k in range(5)), pa.array(rests, pa.binary())],
                    [id_col, "row", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )
                start = end

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(released(cut_up), f"`{id_col}` {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def combinations(counts: np.ndarray, room: int) -> np.ndarray:
    """All fillings of exactly ``room`` by two or three lengths present, as rows of three; 0 is none."""
    sizes = np.flatnonzero(counts[:room])
    sizes = sizes[sizes > 0]
    here = np.zeros(room + 1, bool)
    here[sizes] = True
    here[0] = True
    first, second = np.meshgrid(sizes, sizes, indexing="ij")
    third = room - first - second
    ok = (first >= second) & (third >= 0) & (second >= third) & here[np.maximum(third, 0)]
    return np.stack([first[ok], second[ok], third[ok]], axis=1)


def solve(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts ``x >= 0`` of least ``|A x - counts|^2``, ``A`` the lengths in each combination.

    Accelerated projected gradients; each variable has its own step, from the row sums of ``A'A``,
    which bound it since ``A`` has no negative entry.
    """
    if not len(combos):
        return np.zeros(0)
    target = counts.astype(np.float64)
    target[0] = 0

    def held(x: np.ndarray) -> np.ndarray:
        y = np.bincount(combos.ravel(), weights=np.repeat(x, combos.shape[1]), minlength=len(counts))
        y[0] = 0
        return y

    def back(y: np.ndarray) -> np.ndarray:
        return y[combos].sum(axis=1)

    scale = back(held(np.ones(len(combos))))
    x = ahead = np.maximum(back(target) / scale, 0)
    pace = 1.0
    for _ in range(steps):
        new = np.maximum(ahead - back(held(ahead) - target) / scale, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / next_pace * (new - x)
        x, pace = new, next_pace
    return x


@dataclass(frozen=True)
class Plan:
    """Patterns of whole pieces with how often each is used; pieces of ``loose`` lengths beyond those go end to end."""

    patterns: list[tuple[list[int], int]]
    loose: dict[int, int]
    capacity: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] += n
    patterns = [([capacity], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    combos = combinations(left, capacity)
    x = solve(combos, left, steps)

    def take(k: int, most: int) -> None:
        items = [int(s) for s in combos[k] if s]
        sizes, copies = np.unique(items, return_counts=True)
        times = min(most, int((left[sizes] // copies).min()))
        if times:
            left[sizes] -= copies * times
            patterns.append((items, times))

    order = np.argsort(-x, kind="stable")
    for k in order[x[order] >= 1]:
        take(int(k), int(x[k]))
    parts = x - np.floor(x)
    order = np.argsort(-parts, kind="stable")
    for k in order[parts[order] > 1e-6]:
        take(int(k), 1)

    loose: dict[int, int] = {}
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        room = capacity - top
        sizes = np.flatnonzero(rest[: room + 1])
        pairs = sizes[(rest[room - sizes] > 0) & ((2 * sizes != room) | (rest[sizes] > 1))]
        if room <= capacity and rest[room] > 0:
            pattern = [top, room]
        elif len(pairs):
            pattern = [top, int(pairs[-1]), room - int(pairs[-1])]
        else:
            pattern = _complete(left, [top], room)
        if sum(pattern) == capacity:
            patterns.append((pattern, _use(left, pattern)))
        else:
            loose[top] = int(left[top])
            left[top] = 0
    return Plan(patterns, loose, capacity)


class Places:
    """Where the piece of a length and rank goes: arrays bounded by the plan."""

    def __init__(self, made: Plan) -> None:
        used: dict[int, int] = {}
        rows, sequence, capacity = [], 0, made.capacity
        for pattern, times in made.patterns:
            offset = 0
            for size in sorted(set(pattern), reverse=True):
                copies, first = pattern.count(size), used.get(size, 0)
                used[size] = first + copies * times
                rows.append((size, first, sequence, copies, offset))
                offset += size * copies
            sequence += times
        rows.sort()
        self.capacity, self.base = capacity, sequence
        self.size, self.first, self.sequence, self.copies, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.group = {size: (int(np.searchsorted(self.size, size)), int(np.searchsorted(self.size, size, side="right"))) for size in used}
        self.used, self.stream, total = used, {}, 0
        for size in sorted(made.loose, reverse=True):
            self.stream[size] = total
            total += size * made.loose[size]
        self.even = total - total % capacity
        ends, at = [], self.even
        for power in reversed(range(capacity.bit_length())):
            if total % capacity >> power & 1:
                at += 1 << power
                ends.append(at)
        self.ends = np.array(ends, np.int64)  # of the last sequences, each a power of two long

    def whole(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.group[size]
        k = low + np.searchsorted(self.first[low:high], rank, side="right") - 1
        since = rank - self.first[k]
        return self.sequence[k] + since // self.copies[k], self.offset[k] + since % self.copies[k] * size

    def ended(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stream's sequence at ``at``, its place in it and where it ends."""
        tail = np.searchsorted(self.ends, at, side="right")
        starts = np.concatenate([[self.even], self.ends])[tail]
        stops = np.concatenate([self.ends, [self.even]])[tail]
        late = at >= self.even
        number = np.where(late, self.even // self.capacity + tail, at // self.capacity)
        inside = np.where(late, at - starts, at % self.capacity)
        return number + self.base, inside, np.where(late, stops, at - at % self.capacity + self.capacity)

    def placed(self, row: np.ndarray, length: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """``(row, at, length, sequence, offset, whole)`` arrays; cut pieces have several rows."""
        out = []
        for size in np.unique(length).tolist():
            mine = length == size
            rows, ranks = row[mine], rank[mine]
            whole = ranks < self.used.get(size, 0)
            if whole.any():
                n = int(whole.sum())
                out.append((rows[whole], np.zeros(n, np.int64), np.full(n, size), *self.whole(size, ranks[whole]), np.ones(n, bool)))
            rows, ranks = rows[~whole], ranks[~whole]
            if not len(rows):
                continue
            start = self.stream[size] + (ranks - self.used.get(size, 0)) * size
            at, stop = start, start + size
            while len(at):
                sequence, offset, end = self.ended(at)
                upto = np.minimum(end, stop)
                out.append((rows, at - start, upto - at, sequence, offset, upto - at == size))
                more = upto < stop
                rows, start, stop, at = rows[more], start[more], stop[more], upto[more]
        return out


def _placing(places: Places) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                out = places.placed(*(batch.column(k).to_numpy() for k in range(3)))
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "at", "length", "sequence_id", "offset", "whole"])

    return run


def _checked(batches: Batches) -> Batches:
    """``(row, at, ids_crc32)`` of the parts of cut pieces."""
    for batch in batches:
        rows = zip(batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        sums = [zlib.crc32(ids[4 * at : 4 * (at + n)]) for ids, at, n in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["row", "at", "ids_crc32"])


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the id, ``start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null and empty texts are one piece with the closing id. Rows that repeat an id are each packed.
    Every sequence is full or a power of two long, so nothing is padded. An empty table gives no
    rows; other columns do not matter.
    """
    spark = docs.sparkSession
    cut_up = saved(pieces(docs, path or default_tokenizer(), id_col, text_col, capacity))
    rests = cut_up.where(F.col("length") < capacity)
    made = plan({r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rests.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))).join(starts, ["length", "salt"])
    placed = saved(ranked.select("row", "length", (F.col("nth") + F.col("ahead") - 1).alias("rank")).mapInArrow(_placing(Places(made)), PLACED))
    facts = cut_up.select(id_col, "row", "start", "ids_crc32", "doc_tokens", "length")
    out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    alone = facts.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    whole = facts.drop("length").join(placed.where("whole"), "row")
    held = rests.where(F.col("length").isin(list(made.loose))).select("row", "ids")
    parts = beside(held, placed.where("NOT whole").select("row", "at", F.col("length").alias("n")), "row").select("row", "at", "n", "ids").mapInArrow(_checked, "row long, at long, ids_crc32 long")
    pieces_cut = facts.drop("length", "ids_crc32").join(placed.where("NOT whole").join(parts, ["row", "at"]), "row").withColumn("start", F.col("start") + F.col("at"))
    return alone.select(out).unionByName(whole.select(out)).unionByName(pieces_cut.select(out))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
