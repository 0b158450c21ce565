"""URL expressions on Columns: parts, identity keys, vetoes. Pattern based, so they never raise."""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

HOST = r"^https?://(?:[^/@?#]*@)?(\[[^\]]+\]|[^/:?#]+)"
PORT = r"^https?://(?:[^/@?#]*@)?(?:\[[^\]]+\]|[^/:?#]+):([0-9]+)(?:[/?#]|$)"
TOKEN_HINT = r"(?i)[?&](token|auth|auth_key|sign|signature|expires?|wssecret|wstime|txsecret|txtime)="
MAX_URL = 2048
# fixed values: query keys that change from day to day and do not name a route, alone or at one end of a key
VOLATILE = (
    "token", "access_token", "sign", "signature", "expires", "expire", "expiry", "exp",
    "wssecret", "wstime", "timestamp", "auth", "authkey", "auth_key", "txsecret", "txtime",
)
VOLATILE_START, VOLATILE_END = "token_", "_token"
# fixed values: query keys that only change how a route is shown, and file names of one stream's variants
DISPLAY = ("playlive", "authid", "blog.ntnas.top", "checkedby:iptvcat.org")
VARIANT_FILE = r"/(?:master|playlist|index|chunklist[^/]*)\.m3u8$"


def host(url: Column) -> Column:
    """Lower-case host, brackets of IPv6 literals stripped; empty for anything but http(s)."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"^\[|\]$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def valid(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#]+"), F.lit(False))


def split_options(raw: Column) -> Column:
    """``url$options`` as a struct, trailing commas and semicolons off the URL."""
    parts = F.split(F.trim(raw), r"\$", 2)
    return F.struct(F.regexp_replace(parts.getItem(0), r"[,;]+$", "").alias("url"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("options"))


def urls_in(raw: Column) -> Column:
    """All http(s) URLs of a text, each ended by white space or ``#``."""
    return F.regexp_extract_all(raw, F.lit(r"(https?://[^\s#]+)"), 1)


def port(url: Column) -> Column:
    """The port that the URL names, 1 to 65535; null for none."""
    said = F.regexp_extract(url, PORT, 1).try_cast("int")
    return F.when((said >= 1) & (said <= 65535), said)


def route_key(url: Column) -> Column:
    """Identity of a route: scheme, host, port if named, decoded path with slashes collapsed; no query.

    A path with a broken escape stays as it is; anything but http(s) gives an empty key.
    """
    raw = path(url)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    place = F.regexp_replace(F.when(decoded == "", F.lit("/")).otherwise(decoded), "/+", "/")
    named = F.concat(F.lower(F.regexp_extract(url, "^(https?)://", 1)), F.lit("://"), host(url), F.coalesce(F.concat(F.lit(":"), port(url)), F.lit("")), place)
    return F.when(host(url) == "", F.lit("")).otherwise(named)


def _decoded(raw: Column) -> Column:
    """A query part read: ``+`` is a space, a broken escape stays."""
    return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))


def _encoded(said: Column) -> Column:
    return F.replace(F.replace(F.url_encode(said), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """``(k, v)`` of the query in order, decoded; a part without ``=`` has an empty value."""

    def pair(part: Column) -> Column:
        key = F.substring_index(part, "=", 1)
        return F.struct(_decoded(key).alias("k"), _decoded(F.substring(part, F.length(key) + 2, F.length(part))).alias("v"))

    return F.transform(F.filter(F.split(query(url), "&"), lambda p: p != ""), pair)


def _asked(pairs: Column) -> Column:
    said = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(said != "", F.concat(F.lit("?"), said)).otherwise("")


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "(?i)^(https?)://", 1))


def without_volatile(url: Column) -> Column:
    """Identity of a route by its query too: scheme, host, port if named, decoded path with slashes
    collapsed, and the query without volatile keys, sorted by lower-case key and value; no fragment.

    Anything but http(s) stays as it is.
    """
    url = F.trim(url)
    raw = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    place = F.regexp_replace(F.when(decoded == "", F.lit("/")).otherwise(decoded), "/+", "/")

    def lasting(p: Column) -> Column:
        key = F.lower(p["k"])
        return ~(key.isin(*VOLATILE) | F.startswith(key, F.lit(VOLATILE_START)) | F.endswith(key, F.lit(VOLATILE_END)))

    ranked = F.transform(F.filter(query_pairs(url), lasting), lambda p, i: F.struct(F.lower(p["k"]).alias("low"), p["v"].alias("v"), i.alias("i"), p["k"].alias("k")))
    named = F.concat(_scheme(url), F.lit("://"), host(url), F.coalesce(F.concat(F.lit(":"), port(F.lower(url)).cast("string")), F.lit("")), place, _asked(F.array_sort(ranked)))
    return F.when(_scheme(url) == "", url).otherwise(named)


def equivalent(url: Column, listed: Column | bool = True) -> Column:
    """Key that variants of one stream share: default port, variant file and display keys do not count.

    Scheme, path and all other query pairs do. Only routes of ``listed`` stations have such variants;
    for the others, and for anything but http(s), the key is the URL itself.
    """
    name, said = host(url), port(F.lower(url))
    shown = F.when(name.contains(":"), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    usual = F.when(_scheme(url) == "https", 443).otherwise(80)
    ending = F.when(said.isNull() | (said == usual), F.lit("")).otherwise(F.concat(F.lit(":"), said.cast("string")))
    place = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1), VARIANT_FILE, "/<hls>")
    pairs = F.array_sort(F.filter(query_pairs(url), lambda p: ~p["k"].isin(*DISPLAY)))
    key = F.concat(_scheme(url), F.lit("://"), shown, ending, place, _asked(pairs))
    return F.when((listed if isinstance(listed, Column) else F.lit(listed)) & (_scheme(url) != ""), key).otherwise(url)


def numbers_conflict(label: Column, url: Column) -> Column:
    """The label has a number, the URL has numbers too, and the label's is not among them."""
    named = F.regexp_extract(F.lower(label), r"cctv[\s\-_]*(\d{1,2})", 1)
    found = F.regexp_extract_all(F.lower(url), F.lit(r"cctv[\s\-_]*(\d{1,2})"), 1)
    return (named != "") & (F.size(found) > 0) & ~F.array_contains(found, named)


def expiry(url: Column) -> Column:
    """Epoch seconds in a query value of 10 (seconds) or 13 (milliseconds) digits; null if none."""
    digits = F.regexp_extract(url, r"[?&][^=&]+=(1\d{12}|1\d{9})(?:\D|$)", 1)
    return F.when(F.length(digits) == 13, (digits.try_cast("long") / 1000).cast("long")).otherwise(digits.try_cast("long"))


def short_lived(url: Column, now: Column, hours: int = 24) -> Column:
    """Whether an expiry in the query leaves less than ``hours`` from ``now`` (epoch seconds)."""
    return F.coalesce(expiry(url) - now < hours * 3600, F.lit(False))


def token_hint(url: Column) -> Column:
    return url.rlike(TOKEN_HINT)


def literal_family(host_name: Column) -> Column:
    """4 or 6 for IP literals, 0 for names."""
    return F.when(host_name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), 4).when(host_name.contains(":"), 6).otherwise(0)


@F.pandas_udf(BooleanType())
def safe(urls: pd.Series) -> pd.Series:
    """Bounded, printable, without credentials or token keys, and not aimed at a private address."""

    def ok(url: str | None) -> bool:
        if not url or len(url) > MAX_URL or any(c.isspace() or ord(c) < 32 for c in url):
            return False
        try:
            parts = urlsplit(url)
            name, port = (parts.hostname or "").lower(), parts.port
        except ValueError:
            return False
        if parts.scheme not in ("http", "https") or not name or parts.username or parts.password or port == 0:
            return False
        if any(k.lower() in {"token", "auth", "auth_key", "sign", "signature", "password"} for k, _ in parse_qsl(parts.query, keep_blank_values=True)):
            return False
        try:
            return ipaddress.ip_address(name).is_global
        except ValueError:
            labels = name.rstrip(".").split(".")
            return len(labels) > 1 and all(0 < len(x) <= 63 and x.replace("-", "a").isalnum() and x[0] != "-" and x[-1] != "-" for x in labels) and not name.endswith((".local", ".internal"))

    return urls.map(ok)
