"""Which sources of a language differ in their words, and by which words, in exact integers.

Terms are counted by (lang, source) in the tasks that read the text, then dealt by (lang, term), so
one shuffle gives both the counts and in how many documents a term stands. Kept terms are dealt
into blocks; each block is a dense matrix of all groups of the language by some terms, whose
differences are taken for all pairs of groups at once. Partial pair sums and the best terms of
each block are then merged by group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import Batches, beside, cut, discard, released, stored, table

LEAST_DOCS = 3
UNIT = 1_000_000_000
TOP_TERMS = 200
CELLS = 1 << 18  # of a block's dense matrix, on average
PAIR_CELLS = 1 << 20  # of some groups by all groups by 64 terms, at a time
ENTRIES = 300_000  # different terms counted before a task hands its counts on
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents, partial sums of each task.

    In UTF-8 every byte of a sign beyond ASCII is 128 or more, so a byte table lower-cases A-Z and
    turns all other ASCII into spaces, and the words of the bytes are the terms.
    """

    def count(batches: Batches) -> Batches:
        tally: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in tally.items():
                terms = list(times)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                            pa.array([times[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64()),
                        ],
                        ["lang", "source", "term", "n", "docs"],
                    )
            tally.clear()

        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for i, (lang, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                times, docs = tally.setdefault((lang, source), (Counter(), Counter()))
                words = Counter((texts[i].as_py() or b"").translate(TERM_BYTES).split())
                held -= len(times)
                times.update(words)
                docs.update(words.keys())
                held += len(times)
                if held > ENTRIES:
                    yield from flush()
                    held = 0
        yield from flush()

    plain = docs.select(F.col(text_col).alias("t"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    return plain.mapInArrow(released(count), "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / total)``, by long division in thousands: no product overflows."""
    left, out = counts + 1, np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64)
    for _ in range(3):
        part, left = np.divmod(left * 1000, total)
        out = out * 1000 + part
    return out + 1


FOUND = ["source", "part", "item", "value"]


def _block(top: int) -> Callable[[tuple[pa.Scalar, ...], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial pair sums and the best terms of one block, a slice of its groups at a time.

        Rows with a null term name the language's groups, with ``n`` their sum of counts; the others
        are counts. ``v`` is the language's number of kept terms.
        """
        rows = pa.Table.from_batches(batches)
        source, term = rows.column("source").to_pylist(), rows.column("term").to_pylist()
        n = rows.column("n").to_numpy()
        heads = sorted((i for i, t in enumerate(term) if t is None), key=source.__getitem__)
        names, sums, v = [source[i] for i in heads], n[heads], rows.column("v")[heads[0]].as_py()
        terms = sorted({t for t in term if t is not None})
        place, column = {s: g for g, s in enumerate(names)}, {t: j for j, t in enumerate(terms)}
        dense = np.zeros((len(names), len(terms)), np.int64)
        for i, t in enumerate(term):
            if t is not None:
                dense[place[source[i]], column[t]] = n[i]
        p = shares(dense, (sums + v)[:, None])
        q = shares(dense.sum(axis=0), np.asarray(sums.sum() + v))
        shown, words = pa.array(names, pa.string()), pa.array(terms, pa.string())

        def found(g: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
            lang = pa.repeat(key[0], len(value)).cast(pa.string())
            return pa.RecordBatch.from_arrays([lang, shown.take(pa.array(g)), pa.repeat(part, len(value)), item, pa.array(value)], ["lang", *FOUND])

        at_once = max(1, PAIR_CELLS // (len(names) * max(1, min(len(terms), 64))))
        for g0 in range(0, len(names), at_once):
            mine = p[g0 : g0 + at_once]
            pairs = np.zeros((len(mine), len(names)), np.int64)
            for at in range(0, len(terms), 64):
                other = p[None, :, at : at + 64]
                d = mine[:, None, at : at + 64] - other
                pairs += (d * d // other).sum(axis=2)
            g, h = np.nonzero(np.arange(g0, g0 + len(mine))[:, None] != np.arange(len(names)))
            yield found(g + g0, "pair", shown.take(pa.array(h)), pairs[g, h])
        for g in range(len(names)):
            over = np.flatnonzero((dense[g] > 0) & (p[g] > q))
            d = p[g, over] - q[over]
            value = d * d // q[over]
            first = np.lexsort((over, -value))[:top]  # terms are in order already
            yield found(np.full(len(first), g), "term", words.take(pa.array(over[first])), value[first])

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    line = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(line))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every group ``(lang, source)``.

    ``pair`` rows tell how far the group is from each other group of its language, over all kept
    terms (in ``least`` documents of the language or more); ``term`` rows its ``top`` most
    over-used kept terms. Null text, lang or source is empty; a row is a document, repeated or not;
    a language with one source has no pairs, one without kept terms has pairs of 0 and no terms.
    An empty table gives no rows; other columns do not matter. Sums are exact up to 9 * 10^15 terms
    a language.
    """
    spark = docs.sparkSession
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    by_term = Window.partitionBy("lang", "term")
    one_each = counted(docs, text_col, lang_col, source_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = one_each.withColumn("all_docs", F.sum("docs").over(by_term)).withColumn("first", F.min("source").over(by_term) == F.col("source"))
    kept, path = stored(seen.where(F.col("all_docs") >= least).select("lang", "source", "term", "n", F.col("first").cast("long").alias("leads")))
    sums = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("leads").alias("leads")), ["lang", "source"], "left").fillna(0, ["n", "leads"])
    facts = sums.groupBy("lang").agg(F.sum("leads").alias("v"), F.count("*").alias("groups"))
    facts = cut(facts.select("lang", "v", F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("groups") / CELLS)).cast("long").alias("blocks")))
    heads = beside(sums, facts, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "v")
    body = beside(kept, facts, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "v")
    partial, parts_path = stored(
        body.unionByName(heads).groupBy("lang", "block").applyInArrow(_block(top), "lang string, source string, part string, item string, value long")
        .groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    )
    discard(spark, path)
    terms = _ranked(partial.where("part = 'term'")).where(F.col("rank") <= top)
    return _ranked(partial.where("part = 'pair'")).unionByName(terms)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts JOIN (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}) USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang FROM groups) LEFT JOIN kept USING (lang) GROUP BY lang),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
p AS (SELECT lang, source, term, cells.n, 1 + ({UNIT}::HUGEINT * (cells.n + 1)) // (total + v)::HUGEINT AS p, 1 + ({UNIT}::HUGEINT * (lang_n + 1)) // (langs.n + v)::HUGEINT AS q
 FROM cells JOIN sums USING (lang, source) JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
