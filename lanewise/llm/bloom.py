"""A bitmap of the hashes that two or more rows share, and its test, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import cut

HASHES = 2
MAX_BITS = 1 << 29  # 64 MB of bitmap: the broadcast's bound at any corpus size


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    return min(max_bits, max(1 << 18, 1 << (32 * rows).bit_length()))


def _slots(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) + 1 for i in range(HASHES)]


def shared_slots(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmap rows ``(bucket, bitmap)`` of the slots that two or more rows of ``keys`` hit."""
    hit = keys.select(F.explode(F.array_distinct(F.array(*_slots(F.col(key), bits)))).alias("slot")).groupBy("slot").count().where("count >= 2")
    return cut(hit.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")))


def flag_shared(df: DataFrame, key: str, bitmap: DataFrame, bits: int, flag: str = "_shared") -> DataFrame:
    """Add ``flag``: false only if no other row has the key's hashes."""
    columns = df.columns
    tests = []
    for i, slot in enumerate(_slots(F.col(key), bits)):
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col(f"_map{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        df = df.withColumn(f"_slot{i}", slot)
        df = df.join(F.broadcast(bitmap.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_map{i}"))), F.bitmap_bucket_number(F.col(f"_slot{i}")) == F.col(f"_bucket{i}"), "left")
        tests.append(F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    both = tests[0]
    for t in tests[1:]:
        both = both & t
    return df.select(*[F.col(f"`{c}`") for c in columns], both.alias(flag))
