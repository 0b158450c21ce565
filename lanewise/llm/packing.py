"""Best-fit packing of tokenised documents by bin completion.

Tokenising, cutting, ranking and placing run on Spark; what meets in one place is the histogram of
piece lengths, at most ``CAPACITY`` rows for any corpus. On it a branch-and-bound search completes
one bin pattern at a time around the largest length left: it enumerates undominated fillings of
the free space, applies a filling as often as the counts allow, prunes by the waste bound against
the best complete packing so far (first that of best fit, decreasing), and stops at the lower
bound or after ``NODES`` nodes.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import cut, released, table

CAPACITY = 2048
NODES = 6000
WIDTH = 3
KEPT_WORDS = 200_000  # remembered by a worker in a generation, of which there are two
LONGEST = 64  # signs of a part that is remembered
TOGETHER = 4_000_000  # bytes of text cut at a time
PIECES = "piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of UTF-8 texts as little-endian bytes, with two generations of remembered words.

    Text is cut at ASCII white space, where the tokenizer always ends a token. Many texts are cut
    together, and their words told apart, by numpy and Arrow, which also lower A-Z in words without
    combining marks; Python meets each different part once for all the texts. Latin letters go straight
    to the tokenizer's model in its byte alphabet: its normaliser and splitter would only hand them on;
    a run of ``TAILS`` after them, up to the white space, is a token's worth of its own. All other words
    take the tokenizer's whole path. Texts with ``<|`` may hold special tokens and are encoded whole.
    """

    LATIN = "\u0250"  # below it letters have no decompositions and one lower case
    TAILS = string.punctuation.replace("'", "")  # an apostrophe may begin a token with the letters after it
    LEAD = 0  # signs before a word's letters that belong to it
    WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(True))]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(hidden)}  # the others stand for themselves
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        four = self.four
        return [b"".join([four[i] for i in e.ids]) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, letters: str, lead: str = "") -> bytes:
        """The ids of Latin letters, straight from the model; ``lead`` is in its alphabet."""
        if not letters.isascii():
            letters = letters.encode("utf-8").decode("latin-1").translate(self.alphabet)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(lead + letters)])

    def straight(self, part: str) -> bytes | None:
        """The ids of a part that needs the model alone; None for others."""
        letters = part.lower()
        return self._letters(letters) if letters.isalpha() and max(letters) < self.LATIN else None

    def learn(self, parts: list[str], kept: int = KEPT_WORDS) -> list[bytes]:
        """The ids of different ``parts``; at most ``kept`` in a generation."""
        if len(self.new) + len(parts) > kept:
            self.old, self.new = self.new, {}
        new, old, straight = self.new, self.old, self.straight
        hard = []
        found = list(map(new.get, parts))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            part = parts[k]
            ids = old.get(part)
            if ids is None and (ids := straight(part)) is None:
                hard.append(k)
                continue
            found[k] = ids
            if len(part) <= LONGEST:
                new[part] = ids
        for at in range(0, len(hard), 20_000):
            some = hard[at : at + 20_000]
            for k, ids in zip(some, self._encode([parts[k] for k in some]), strict=True):
                found[k] = ids
                if len(parts[k]) <= LONGEST:
                    new[parts[k]] = ids
        return found

    def _parts(self, words: pa.Array) -> pa.DictionaryArray:
        """Two parts of each of ``words``: Latin letters (with the signs before them) and their tail, else all of it and nothing."""
        _, starts, data = words.buffers()
        starts = np.frombuffer(starts, np.int64, len(words) + 1)
        bare = pc.utf8_rtrim(words, characters=self.TAILS)
        plain = pc.utf8_is_alpha(pc.utf8_slice_codeunits(bare, self.LEAD) if self.LEAD else bare).to_numpy(zero_copy_only=False)
        plain &= self._latin(words)
        bounds = np.empty(2 * len(words) + 1, np.int64)
        bounds[::2] = starts
        bounds[1::2] = np.where(plain, starts[:-1] + pc.binary_length(bare).to_numpy(), starts[1:])
        return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(bounds), data).dictionary_encode()

    def _latin(self, words: pa.Array) -> np.ndarray:
        """Which of ``words``, none of them empty, have no sign from ``LATIN`` on, as they are and in
        lower case (\u0130 becomes two signs, a letter and a mark that is the tail's)."""
        _, starts, data = words.buffers()
        starts = np.frombuffer(starts, np.int64, len(words) + 1)
        below = np.maximum.reduceat(np.frombuffer(data, np.uint8, starts[-1]), starts[:-1]) < self.LATIN.encode()[0]
        return below & ~pc.match_substring(words, "\u0130").to_numpy(zero_copy_only=False)

    def _lowered(self, words: pa.Array) -> pa.Array:
        """A-Z in lower case where no sign from ``LATIN`` on, such as a combining mark, is in the word:
        there the tokenizer composes signs first, and not all letters compose in both cases."""
        _, starts, data = words.buffers()
        sizes = np.diff(np.frombuffer(starts, np.int64, len(words) + 1))
        signs = np.frombuffer(data, np.uint8, sizes.sum())
        upper = (signs >= 65) & (signs <= 90) & np.repeat(self._latin(words), sizes)
        return pa.LargeStringArray.from_buffers(len(words), starts, pa.py_buffer(signs + np.uint8(32) * upper))

    def _spelt(self, words: pa.Array) -> tuple[np.ndarray, memoryview]:
        """The ids of all ``words`` (none of them empty) in a row, and where those of each begin."""
        words = words.dictionary_encode()
        parts = self._parts(self._lowered(words.dictionary))
        ids = pa.array(self.learn(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(parts.indices)
        _, pairs, body = ids.buffers()
        pairs = np.ascontiguousarray(np.frombuffer(pairs, np.int64, len(ids) + 1)[::2])
        each = pa.Array.from_buffers(pa.large_binary(), len(pairs) - 1, [None, pa.py_buffer(pairs), body]).take(words.indices)
        return np.frombuffer(each.buffers()[1], np.int64, len(each) + 1), memoryview(each.buffers()[2] or b"")

    def ids(self, texts: list[bytes]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if b"<|" in t]
        out = dict(zip(whole, self._encode([texts[i].decode("utf-8") for i in whole]), strict=True))
        cut = [i for i in range(len(texts)) if i not in out]
        data = np.frombuffer(b" ".join([b"", *[texts[i] for i in cut], b""]), np.uint8)
        white = self.WHITE[data]
        first = np.zeros(len(data), bool)
        first[1:] = white[:-1] & ~white[1:]
        signs = data[~white]
        if not len(signs):
            return [out.get(i, b"") for i in range(len(texts))]
        bounds = np.append(np.flatnonzero(first[~white]), len(signs))
        starts, body = self._spelt(pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(signs)))
        ends = np.cumsum([0] + [len(texts[i]) + 1 for i in cut])
        at = starts[np.searchsorted(np.flatnonzero(first), ends)].tolist()
        for k, i in enumerate(cut):
            out[i] = bytes(body[at[k] : at[k + 1]])
        return [out[i] for i in range(len(texts))]


_tokenizers: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each text's ids and a closing 0, cut at ``capacity``."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizers.get(path)
        if words is None:
            words = _tokenizers[path] = WordIds(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            where, rows = [], []
            start = 0
            while start < len(texts):
                end, size = start + 1, len(texts[start])
                while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                    size += len(texts[end])
                    end += 1
                for i, ids in enumerate(words.ids(texts[start:end]), start):
                    ids += b"\0\0\0\0"
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        where.append(i)
                        rows.append((n, at // 4, len(part) // 4, zlib.crc32(part)))
                start = end
            columns = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), pa.array(columns[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(columns[:, k])) for k in (1, 2, 3))],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )
        words.new, words.old = {}, {}  # the tokenizer stays with the worker, its words do not

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(released(cut_up), f"`{id_col}` {kind}, {PIECES}")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the volume bound and, for each threshold, large items apart."""
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    for t in range(half + 1):
        alone = int(number[-1] - number[capacity - t])
        large, large_volume = int(number[capacity - t] - number[half]), int(volume[capacity - t] - volume[half])
        small = int(volume[half] - (volume[t - 1] if t else 0))
        best = max(best, alone + large + max(0, -(-(small - (large * capacity - large_volume)) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, the fullest first and of equals those of larger items.

    One item: the largest that fits. Two or three: each with the largest last item that fits, kept
    only if fuller than the best with fewer items (else the fewer dominate). None: the empty one.
    """
    sizes = np.flatnonzero(counts[: room + 1])
    sizes = sizes[sizes > 0][::-1]
    if not len(sizes):
        return [()]
    below = np.zeros(room + 1, np.int64)  # the largest size present that is at most x
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    found: list[tuple[int, ...]] = [(int(sizes[0]),)]
    best = int(sizes[0])

    def offer(first: np.ndarray, *rest: np.ndarray) -> None:
        nonlocal best
        total = first + sum(rest)
        ok = np.flatnonzero((total > best) & (rest[-1] > 0))
        for k in ok[np.argsort(-total[ok], kind="stable")][:width]:
            items = tuple(int(x[k]) for x in (first, *rest))
            if all(counts[x] >= items.count(x) for x in items):
                found.append(items)
        best = max([best, *(sum(f) for f in found)])

    if best < room:
        last = np.minimum(below[room - sizes], sizes)
        offer(sizes, last)
    if best < room:
        top = sizes[:64]
        second = np.minimum(sizes[None, :], top[:, None])
        left = room - top[:, None] - second
        third = np.where(left >= 0, below[np.maximum(left, 0)], 0)
        third = np.minimum(third, second)
        offer(np.broadcast_to(top[:, None], second.shape).ravel(), second.ravel(), third.ravel())
    return sorted(found, key=lambda f: (-sum(f), tuple(-x for x in f)))[:width]


def _complete(counts: np.ndarray, pattern: list[int], room: int) -> list[int]:
    """Close ``pattern`` by best fit: again and again the largest length left that fits."""
    left = counts.copy()
    for x in pattern:
        left[x] -= 1
    while room > 0:
        fit = np.flatnonzero(left[1 : room + 1] > 0)
        if not len(fit):
            break
        x = int(fit[-1]) + 1
        times = min(int(left[x]), room // x)
        pattern += [x] * times
        left[x] -= times
        room -= x * times
    return pattern


def _use(counts: np.ndarray, pattern: list[int]) -> int:
    """Take ``pattern`` off ``counts`` as often as it goes; how often that was."""
    sizes, copies = np.unique(pattern, return_counts=True)
    times = int((counts[sizes] // copies).min())
    counts[sizes] -= copies * times
    return times


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> list[tuple[list[int], int]]:
    """``(lengths in one bin, number of such bins)``; together they hold the histogram exactly."""
    start = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        start[size] += n
    bound = lower_bound(start, capacity)

    left, best = start.copy(), []
    while left.any():  # the first incumbent: best fit, decreasing
        top = int(np.flatnonzero(left)[-1])
        pattern = _complete(left, [top], capacity - top)
        best.append((pattern, _use(left, pattern)))
    fewest = sum(n for _, n in best)

    sizes = np.arange(capacity + 1)
    stack = [(start, [], 0)]
    while stack and fewest > bound and nodes > 0:
        nodes -= 1
        left, done, used = stack.pop()
        if not left.any():
            if used < fewest:
                best, fewest = done, used
            continue
        if used + -(-int((left * sizes).sum()) // capacity) >= fewest:  # waste bound
            continue
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        choices = fillings(left, capacity - top, width)
        left[top] += 1
        for filling in reversed(choices):
            rest = left.copy()
            pattern = _complete(rest, [top, *filling], capacity - top - sum(filling))
            times = _use(rest, pattern)
            stack.append((rest, [*done, (pattern, times)], used + times))
        del stack[: max(0, len(stack) - 4 * capacity)]
    return best


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, last rank, first sequence, copies a sequence, offset)`` rows."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            copies = pattern.count(size)
            first = rank.get(size, 0)
            rank[size] = first + copies * times
            rows.append((size, first, rank[size] - 1, sequence, copies, offset))
            offset += size * copies
        sequence += times
    return rows


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece holding only the closing id. Rows that repeat an id are each
    packed. Other columns do not matter; an empty table gives no rows. The number of sequences is
    the smallest that the search finds; every piece has exactly one place.
    """
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, path or default_tokenizer(), id_col, text_col, capacity))
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).toArrow().to_pylist()}
    places = F.broadcast(  # a few rows for each length at most: bounded by the capacity
        spark.createDataFrame(slots(plan(histogram, capacity)), "size long, first long, last long, base long, copies long, shift long")
    )
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut_up.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "_salt").orderBy(id_col, "piece")
    ranked = salted.withColumn("rank", F.row_number().over(inside)).join(starts, ["length", "_salt"]).withColumn("rank", F.col("rank") + F.col("ahead") - 1)
    placed = ranked.join(places, (F.col("length") == F.col("size")) & F.col("rank").between(F.col("first"), F.col("last")))
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.expr("(rank - first) div copies")).alias("sequence_id"),
        (F.col("shift") + F.expr("(rank - first) % copies") * F.col("length")).alias("offset"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
