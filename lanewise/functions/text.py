"""Text expressions on Columns: names, station keys, playlist attributes, parsed numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: words that only describe picture quality, and what they are cut to
QUALITY_WORDS = r"(?i)(4k|8k|uhd|fhd|hdr|hevc|h\.?26[45]|1080[pi]?|720p?|超清|高清|标清|蓝光|hd|sd)"
HEIGHT_WORDS = ((r"(?i)(8k|4320)", 4320), (r"(?i)(4k|uhd|2160)", 2160), (r"(?i)(fhd|1080)", 1080), (r"(?i)(720|超清|高清|hd)", 720))
NAME_LIMIT = 180


def clean_name(raw: Column, limit: int = NAME_LIMIT) -> Column:
    """Without byte-order marks and quotes, white space collapsed, at most ``limit`` signs."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), "[﻿\"]", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, limit)


def compact(raw: Column) -> Column:
    """Lower case, without quality words, white space and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(raw), QUALITY_WORDS, ""), r"[\s\-_+·()（）\[\]【】,，.]+", "")


def strip_suffixes(raw: Column, suffixes: str = QUALITY_WORDS.removeprefix("(?i)")) -> Column:
    """Drop technical suffixes from the end until none is left (one greedy expression)."""
    return F.trim(F.regexp_replace(raw, rf"(?i)([\s\-_]*{suffixes})+\s*$", ""))


def station_key(raw: Column, number: str = r"(?i)cctv[\s\-_]*(\d{1,2}(?:\.5)?)(\+|p(?:lus)?)?") -> Column:
    """Canonical key: ``cctv5``, ``cctv5+``, ``cctv4k``; any other name its compact form."""
    low = F.lower(raw)
    digits = F.regexp_extract(low, number, 1)
    plus = F.regexp_extract(low, number, 2) != ""
    return (
        F.when(low.rlike(r"cctv[\s\-_]*4k"), "cctv4k")
        .when(low.rlike(r"cctv[\s\-_]*8k"), "cctv8k")
        .when((digits == "5.5") | ((digits == "5") & plus), "cctv5+")
        .when(digits != "", F.concat(F.lit("cctv"), F.regexp_replace(digits, r"^0+(?=\d)", "")))
        .otherwise(compact(raw))
    )


def display_name(key: Column) -> Column:
    """``cctv5`` as ``CCTV-5``; other keys as they are."""
    return F.when(key.rlike(r"^cctv\d"), F.concat(F.lit("CCTV-"), F.upper(F.substring(key, 5, 20)))).otherwise(key)


def natural_number(raw: Column) -> Column:
    """Sort number of a numbered name: a plus half a step after, 4k at 99, no number 999."""
    key = station_key(raw)
    return (
        F.when(key.isin("cctv4k", "cctv8k"), F.lit(99.0))
        .when(key == "cctv5+", F.lit(5.5))
        .when(key.rlike(r"^cctv\d+$"), F.regexp_extract(key, r"(\d+)", 1).try_cast("double"))
        .otherwise(F.lit(999.0))
    )


def attribute(line: Column, name: str) -> Column:
    """Value of ``name="..."`` in a playlist line; empty if absent."""
    return F.regexp_extract(line, rf'{name}="([^"]*)"', 1)


def with_attribute(line: Column, name: str, value: Column) -> Column:
    """Set ``name="..."``: replaced where present, else put before the last comma."""
    pair = F.concat(F.lit(f'{name}="'), value, F.lit('"'))
    quoted = F.regexp_replace(pair, r"([\\$])", r"\\$1")
    return F.when(line.rlike(rf'{name}="'), F.regexp_replace(line, F.lit(rf'{name}="[^"]*"'), quoted)).otherwise(
        F.regexp_replace(line, F.lit(r"\s*,([^,]*)$"), F.concat(F.lit(" "), quoted, F.lit(",$1")))
    )


def headers(line: Column, names: Mapping[str, str]) -> Column:
    """Map of HTTP header to value for the attributes present in a playlist line."""
    pairs = [x for attr, header in names.items() for x in (F.lit(header), attribute(line, attr))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


def rate(raw: Column) -> Column:
    """``25/1`` or ``25`` as a double; null for a zero or missing divisor or other text."""
    parts = F.split(raw, "/")
    top, low = parts.getItem(0).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 2, F.try_divide(top, low)).otherwise(top)


def labelled_height(raw: Column) -> Column:
    """Picture height that a name claims; 0 if none."""
    found = F.lit(0)
    for pattern, height in HEIGHT_WORDS[::-1]:
        found = F.when(raw.rlike(pattern), F.lit(height)).otherwise(found)
    return found


def video_mode(width: Column, height: Column, fps: Column, field_order: Column) -> Column:
    """Label such as ``1080p50`` or ``1080i25``."""
    order = F.lower(F.coalesce(field_order, F.lit("")))
    scan = F.when(order.isin("progressive", ""), "p").when(order.isin("tt", "bb", "tb", "bt"), "i").otherwise("?")
    return F.when((height > 0) & (width > 0), F.concat(height.cast("string"), scan, F.coalesce(F.round(fps).cast("int").cast("string"), F.lit("")))).otherwise("unknown")


def first_rule(raw: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Value of the first rule whose pattern is found in the text."""
    found = F.lit(other)
    for pattern, value in rules[::-1]:
        found = F.when(raw.rlike(pattern), value).otherwise(found)
    return found


def redact_urls(raw: Column) -> Column:
    return F.regexp_replace(raw, r"https?://\S+", "<url>")


@F.pandas_udf(StringType())
def label_key(raw: pd.Series) -> pd.Series:
    """NFKC and full case folding, white space collapsed: no built-in expression does either."""
    return raw.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))
