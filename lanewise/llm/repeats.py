"""Repeated passages: every byte of a WINDOW-byte string that starts more than once is removed.

Each window is dealt to its anchor, the KGRAM bytes in it with the smallest hash (the rightmost on
ties), which equal windows share; neighbouring windows with one anchor form a run, spanning some
hundred bytes. Runs whose anchor stands nowhere else are dropped behind a bitmap of fixed size.
The rest are grouped by anchor and content, with partial counts, so copies collapse before they
meet: a span seen twice is repeated throughout. Where different spans share an anchor, one copy
of each is fetched and a suffix array over them (linear grouping construction) finds the windows
that also stand in another. Anchors with more than ``CROWD`` different spans (some 2 MB), whose
group would be too large for a task, go window by window through a hash count instead.

``remove_passages`` finds runs of words instead: it writes each word as four bytes of its hash and
looks for windows of that many words, so a passage counts by its words, long or short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.bloom import bits_for, flag_shared, shared_slots
from lanewise.llm.common import released, saved, table, without
from lanewise.llm.suffixes import Rolling, repeated_windows

WINDOW = 400
KGRAM = 64
CROWD = 4_000
OFTEN = 256  # spans of one anchor that are dealt by it
MOST = 1_000_000  # anchors in a broadcast
MAP_BITS = 1 << 28  # 32 MB of bitmap: the broadcast's bound
PASSAGE = 49  # words: a passage of over 50 less its first and last, which may touch its neighbours
CODE = 4  # bytes of a word's hash
BUFFER = 1 << 18  # bytes of documents hashed at a time
BATCH = 1 << 19  # bytes of spans in one suffix array, if their groups allow
SPAN = ["h", "left", "digest"]
RUNS = "id long, crc long, h long, left int, digest long, lo long, size int"


def _runs(data: np.ndarray, ends: np.ndarray, window: int, kgram: int) -> tuple[np.ndarray, ...]:
    """First window, last window, anchor and anchor hash of every run of the joined texts."""
    rolling = Rolling(data)
    n = len(data) - kgram + 1
    grams = rolling.of(np.arange(n), kgram)
    keyed = (grams >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    span = window - kgram + 1
    padded = np.full(-(-n // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    count = len(data) - window + 1
    least = np.minimum(ahead[:count], behind[span - 1 : span - 1 + count])
    anchor = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(count), side="right")
    inside = np.arange(count) + window <= ends[owner]
    new = np.ones(count, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & inside)
    breaks = np.flatnonzero(np.concatenate([(new | ~inside)[1:], [True]]))
    last = breaks[np.searchsorted(breaks, first)]
    return first, last, anchor[first], grams[anchor[first]], owner[first]


def runs(docs: DataFrame, window: int, kgram: int, written: Callable[[bytes], bytes]) -> DataFrame:
    """``(id, crc, h, left, digest, lo, size)`` of every run of every text of ``docs(id, crc, text)``, as
    ``written`` writes it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, crcs, sizes_in = batch.column(0), batch.column(1).to_numpy(), pc.binary_length(batch.column(2)).to_numpy()
            start = 0
            while start < len(ids):
                end, size = start, 0
                while end < len(ids) and (end == start or size + sizes_in[end] <= BUFFER):
                    size += int(sizes_in[end])
                    end += 1
                some = [written(t) for t in batch.column(2).slice(start, end - start).to_pylist()]
                joined = b"".join(some)
                if len(joined) >= window:
                    sizes = np.fromiter(map(len, some), np.int64, len(some))
                    ends = np.cumsum(sizes)
                    first, last, anchor, h, owner = _runs(np.frombuffer(joined, np.uint8), ends, window, kgram)
                    size_of = last - first + window
                    digests = np.fromiter((xxhash.xxh3_64_intdigest(joined[a : a + n]) for a, n in zip(first.tolist(), size_of.tolist(), strict=True)), np.uint64, len(first))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(start + owner)), pa.array(crcs[start + owner]), pa.array(h.view(np.int64)), pa.array((anchor - first).astype(np.int32)),
                            pa.array(digests.view(np.int64)), pa.array(first - (ends - sizes)[owner]), pa.array(size_of.astype(np.int32)),
                        ],
                        ["id", "crc", *SPAN, "lo", "size"],
                    )
                start = end

    return docs.mapInArrow(released(each), RUNS)


def _pieces(flags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Removed stretches (start, end) of flagged window starts, overlapping ones joined."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    gap = np.flatnonzero(np.diff(at) >= window)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + window


def _compare(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of spans ``(h, left, digest, body)`` that come sorted by h."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        flags = repeated_windows([s[3] for s in held], window)
        rows, at = [], 0
        for h, left, digest, body in held:
            for a, b in zip(*_pieces(flags[at : at + len(body)], window), strict=True):
                rows.append((h, left, digest, int(a), int(b)))
            at += len(body)
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*SPAN, "a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] == held[-1][:3]:
                continue  # the same span fetched from repeated rows
            if held and row[0] != held[-1][0] and size >= BATCH:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of crowded spans with its hash."""
    for batch in batches:
        for h, left, digest, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.arange(len(body) - window + 1)
            keys = Rolling(np.frombuffer(body, np.uint8)).of(at, window).view(np.int64)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h] * n, pa.int64()), pa.array([left] * n, pa.int32()), pa.array([digest] * n, pa.int64()), pa.array(keys), pa.array(at.astype(np.int32))], [*SPAN, "key", "a"]
            )


def _with_kinds(spans: DataFrame) -> DataFrame:
    """Different ``spans`` that share their anchor, with how many do. Only those of anchors with at most
    ``OFTEN`` are dealt by anchor; the few other anchors come to their spans."""
    kinds = saved(spans.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    often = kinds.where(F.col("kinds") > OFTEN)
    if often.count() <= MOST:
        often = F.broadcast(often)
    rest = spans.join(often, "h", "left_anti").join(kinds.where(F.col("kinds") <= OFTEN), "h")
    return rest.unionByName(spans.join(often, "h"))


def _as_is(text: bytes) -> bytes:
    return text


def repeated(docs: DataFrame, window: int = WINDOW, kgram: int = KGRAM, crowd: int = CROWD, written: Callable[[bytes], bytes] = _as_is) -> DataFrame:
    """Stretches ``(id, crc, a, b)`` to remove from the texts of ``docs(id long, crc long, text binary)``
    without nulls; they may overlap, and count bytes of what ``written`` makes of a text. Rows are told
    apart by id and crc."""
    found = saved(runs(docs, window, kgram, written))
    bits = bits_for(found.count(), MAP_BITS)
    shared = flag_shared(found, "h", shared_slots(found, "h", bits), bits).where("_shared").drop("_shared")
    spans = saved(shared.groupBy(*SPAN).agg(F.count("*").alias("copies"), F.min(F.struct("id", "crc", "lo", "size")).alias("one")))
    whole = spans.where("copies > 1").select(*SPAN, F.lit(0).alias("a"), F.col("one.size").alias("b"))
    asked = _with_kinds(spans).select(*SPAN, "kinds", "one.*").groupBy("id", "crc").agg(F.collect_list(F.struct(*SPAN, "kinds", "lo", "size")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = written(text)
                rows += [(s["h"], s["left"], s["digest"], s["kinds"], text[s["lo"] : s["lo"] + s["size"]]) for s in wanted]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [*SPAN, "kinds", "body"])

    keyed = docs.select(F.col("id").alias("_id"), "text", F.col("crc").alias("_crc"))
    fetched = keyed.join(asked, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_crc") == F.col("crc"))).select("text", "asked")
    bodies = saved(fetched.mapInArrow(released(fetch), "h long, left int, digest long, kinds long, body binary"))
    few = bodies.where(F.col("kinds") <= crowd).select(*SPAN, "body").repartition("h").sortWithinPartitions(*SPAN)
    parts = few.mapInArrow(released(lambda b: _compare(b, window)), "h long, left int, digest long, a int, b int")
    crowded = bodies.where(F.col("kinds") > crowd).select(*SPAN, "body").dropDuplicates(SPAN)
    single = crowded.mapInArrow(released(lambda b: _windows(b, window)), "h long, left int, digest long, key long, a int")
    twice = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    alone = single.join(twice, "key").select(*SPAN, "a", (F.col("a") + window).alias("b"))
    removed = whole.unionByName(parts).unionByName(alone)
    return shared.join(removed, SPAN).select("id", "crc", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, crc, text)`` as ``repeated`` reads it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(text).alias("crc"), text.cast("binary").alias("text"))


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, bounds: Callable[[bytes, list], list[tuple[int, int]]]) -> DataFrame:
    """``docs`` plus ``n_bytes, n_removed, n_spans`` and ``kept``, without the bytes that ``bounds`` makes of
    each text's stretches ``gone(id, crc, a, b)``."""
    gone = gone.groupBy("id", "crc").agg(F.collect_list(F.struct("a", "b")).alias("_gone")).select(F.col("id").alias("_id"), F.col("crc").alias("_crc"), "_gone")
    kept = without(docs, "n_bytes", "n_removed", "n_spans", "kept", "_gone", "_id", "_crc")
    joined = kept.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.crc32(F.coalesce(text_col, F.lit(""))) == F.col("_crc")), "left").drop("_id", "_crc")
    at, gone_at = kept.columns.index(text_col), len(kept.columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(gone_at).to_pylist(), strict=True):
                text, out, end, n = text or b"", [], 0, 0
                for a, b in sorted(bounds(text, [(g["a"], g["b"]) for g in gone])) if gone else ():
                    if a > end or not n:
                        out.append(text[end:a])
                        n += 1
                    end = max(end, b)
                out.append(text[end:])
                left = b"".join(out)
                rows.append((len(text), len(text) - len(left), n, left))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            added = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], [*batch.schema.names[:-1], "n_bytes", "n_removed", "n_spans", "kept"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return joined.select(*[F.col(f"`{c}`") for c in kept.columns], "_gone").mapInArrow(released(each), f"{shape}, n_bytes long, n_removed long, n_spans long, kept binary")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """All rows and columns of ``docs``, plus ``n_bytes, n_removed, n_spans`` and ``kept`` (binary).

    Null text counts as empty and, like any text under ``window`` bytes, loses nothing. Rows that
    repeat id and text are documents of their own, so their windows are all repeated. Input columns
    named like an added column are replaced. An empty table gives no rows. Ids are read as longs.
    """
    return _without(docs, repeated(_keyed(docs, id_col, text_col), window, crowd=crowd), id_col, text_col, lambda text, gone: gone)


def _word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text, or of several joined by white space, start and end."""
    inside = np.concatenate([[False], (text != 32) & ((text < 9) | (text > 13)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _coded(text: bytes) -> bytes:
    """``text`` with each word written as ``CODE`` bytes of its hash, and nothing else."""
    data = np.frombuffer(text, np.uint8)
    start, end = _word_bounds(data)
    return (Rolling(data).of(start, end - start) >> np.uint64(32)).astype("<u4").tobytes() if len(start) else b""


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE, crowd: int = CROWD) -> DataFrame:
    """Like ``remove``, for every run of ``words`` words (between ASCII white space, told apart by 32 bits
    of hash each) that also starts anywhere else; bytes from its first word to its last are removed.

    Texts of fewer words lose nothing; white space around a removed passage stays, also between two
    that follow each other.
    """
    gone = repeated(_keyed(docs, id_col, text_col), CODE * words, crowd=crowd, written=_coded)

    def bounds(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
        start, end = _word_bounds(np.frombuffer(text, np.uint8))
        return [(int(start[-(-a // CODE)]), int(end[b // CODE - 1])) for a, b in _joined(gone)]

    return _without(docs, gone, id_col, text_col, bounds)


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches in order, with overlapping ones joined; those that only touch stay apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
