"""Document fingerprints by winnowing, all in DataFrame functions.

A text's tokens (runs without white space, cut at ``TOKEN`` signs) are hashed, hashes of ``GRAM``
neighbouring tokens are rolled together, and of every ``WINDOW`` neighbouring grams the smallest is
chosen, the rightmost on ties. Two texts that share ``GRAM + WINDOW - 1`` tokens in a row therefore
share a chosen gram. Windows also hang over both ends of a text, so short texts have choices too and
every text, of whatever length, is treated alike. A chosen gram is one long: its hash in the high
``64 - POSITION_BITS - 1`` bits and, below, the largest position less its own, so that ``least`` alone
picks the rightmost of equal hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import cut, table

TOKEN = 16
GRAM = 4  # a power of two, as WINDOW: each is reached by doubling
WINDOW = 8
BEYOND = (1 << 63) - 1  # stands before the first and after the last gram, above every gram
POSITION_BITS = 27
STEP = 32
SPLIT = 32  # equal ranges of ids in each of the ranges of equal rows
BUCKETS = 16384


def _shifted(values: Column, by: int, both: Callable[[Column, Column], Column]) -> Column:
    """``both`` of each value and the one ``by`` places later."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(1 + by), n), both)


def _doubled(df: DataFrame, column: str, span: int, both: Callable[[Column, Column], Column]) -> DataFrame:
    by = 1
    while by < span:
        df = df.withColumn(column, _shifted(F.col(column), by, both))
        by *= 2
    return df


def winnowed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the array of chosen grams of column ``text``, in order of position."""
    df = df.withColumn("_hash", F.transform(F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN), 0), lambda t: F.xxhash64(t)))
    df = df.withColumn("_gram", F.col("_hash"))
    df = _doubled(df, "_gram", GRAM, lambda a, b: F.xxhash64(a, b))
    short = F.when(F.size("_hash") > 0, F.array(F.xxhash64("_hash"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_gram", F.when(F.size("_gram") > 0, F.col("_gram")).otherwise(short))
    last = (1 << POSITION_BITS) - 1
    pack = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(F.lit(last) - i)
    edge = F.array_repeat(F.lit(BEYOND), WINDOW - 1)
    df = df.withColumn("_low", F.transform("_gram", pack))
    df = df.withColumn("_low", F.when(F.size("_low") > 0, F.concat(edge, F.col("_low"), edge)).otherwise(F.col("_low")))
    df = _doubled(df, "_low", WINDOW, lambda a, b: F.least(a, b))
    return df.withColumn(out, F.array_distinct("_low")).drop("_hash", "_gram", "_low")


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    joined = F.size(a) + F.size(b) - shared
    return F.when(joined == 0, F.lit(1.0)).otherwise(shared / F.greatest(joined, F.lit(1)))


def shown(chosen: Column) -> Column:
    """The chosen grams as hexadecimal numbers, in order of position."""
    return F.array_join(F.transform(chosen, lambda x: F.hex(x)), " ")


def with_next(docs: DataFrame, id_col: str, *carried: str, buckets: int = BUCKETS, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Rows of ``docs`` with ``next_<c>`` for each carried column: that of the next row by id.

    Ids fall into ``buckets / SPLIT`` ranges of about as many rows each, wherever the ids lie, and each of
    those into ``SPLIT`` equal ranges of ids. A range's first row is also sent, as a guest, to the last range before it that has rows (the first range's to
    the very last), so each range finds every next row on its own: rows shuffle once and no window runs
    over the whole table, only over one row a range. ``prepare`` runs after the shuffle and before the
    window.
    """
    rest = [c for c in docs.columns if c != id_col]
    number = F.col(id_col).cast("long")
    parts = max(1, buckets // SPLIT)
    low, high, shares = docs.agg(F.min(number), F.max(number), F.percentile_approx(number, [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()
    low, high = low or 0, high or 0
    starts = sorted({low, *(shares or [])})
    widths = [-(-(b - a) // SPLIT) for a, b in zip(starts, [*starts[1:], high + 1], strict=True)]
    listed = lambda some: f"array({', '.join(f'{x}L' for x in some)})"
    steps = [starts[k : k + STEP] for k in range(0, len(starts), STEP)]  # looked up in two steps
    past = lambda some: f"size(filter({some}, b -> b <= _id))"
    docs = docs.withColumn("_id", number).withColumn("_step", F.expr(past(listed(s[0] for s in steps))))
    docs = docs.withColumn("_part", F.expr(f"(_step - 1) * {STEP} + {past(f'get(array({", ".join(map(listed, steps))}), _step - 1)')}"))
    place = F.expr(f"(_part - 1) * {SPLIT} + (_id - get({listed(starts)}, _part - 1)) div get({listed(widths)}, _part - 1)")
    bucket = F.when(number.isNull(), F.lit(-1)).otherwise(place).cast("long")
    ranged = docs.withColumn("_bucket", bucket).drop("_id", "_step", "_part")
    firsts = ranged.groupBy("_bucket").agg(F.min(id_col).alias("_first"))
    line, all_rows = Window.orderBy("_bucket"), Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = cut(firsts.select(F.col("_bucket").alias("_of"), "_first", F.coalesce(F.lag("_bucket").over(line), F.last("_bucket").over(all_rows)).alias("_before")))
    at_home = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest"))
    away = F.struct(F.col("_before").alias("b"), F.lit(True).alias("guest"))
    sent = (
        ranged.join(F.broadcast(firsts), F.col("_bucket") == F.col("_of"))
        .withColumn("_at", F.explode(F.when(F.col(id_col).eqNullSafe(F.col("_first")), F.array(at_home, away)).otherwise(F.array(at_home))))
        .withColumns({"_bucket": F.col("_at.b"), "_guest": F.col("_at.guest")}).drop("_at", "_of", "_first", "_before")
    )
    dealt = prepare(sent.repartition("_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_guest", id_col, *rest)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("NOT _guest").drop("_bucket", "_guest")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    Null text counts as empty; a text without tokens has the empty fingerprint, and two empty
    fingerprints are alike (1). Fewer than GRAM tokens make one gram of all. Rows repeating an id follow each other by text. A lone row is its own next row.
    Other columns do not matter; an empty table gives no rows.
    """
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    pair = with_next(texts, id_col, "_text", "_chosen", prepare=lambda df: winnowed(df, "_text", "_chosen"))
    half = F.expr("char_length(_text) div 2").cast("int")
    pair = pair.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("next__text", F.lit(1), half)))
    pair = winnowed(pair, "_edited", "_edited_chosen")
    sets = pair.withColumns({f"_set{c}": hashes(F.col(c)) for c in ("_chosen", "_edited_chosen", "next__chosen")})
    return sets.select(
        id_col, F.length("_text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        shown(F.col("_chosen")).alias("fingerprint"), shown(F.col("_edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("_set_chosen"), F.col("_set_edited_chosen")).alias("near_edited"),
        likeness(F.col("_set_chosen"), F.col("_setnext__chosen")).alias("near_next"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
