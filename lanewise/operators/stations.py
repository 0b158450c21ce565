"""Which rows are linear stations that the viewer wants: ordered rules over name, attributes, group and URL.

Each function names the first rule that applies, so rows can be kept and reasons counted in one pass.
Patterns use Unicode word bounds; null names, attributes and groups count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.functions import urls
from lanewise.operators.scores import gate

# fixed values: groups, words and hosts that must match the published lists
BLOCKED_GROUPS = ("纪录片", "中文纪录", "电影", "中文电影", "新闻", "国际", "韩国")
ENGLISH = (
    r"(?iU)(?<![a-z])(bbc|cnn|fox\s*news|nbc(lx|\s*news)?|cbs\s*news|abc\s*news|bloomberg|cnbc|reuters|sky\s*news|euronews|i24news|voa|newsmax"
    r"|cheddar\s*news|channel\s*newsasia|al\s*jazeera|france\s*24|cgtn|cna)(?![a-z])"
    r"|\bdw(\s+(english|news))?\b|nhk\s*world|kbs\s*world|arirang|taiwan\s*(\+|plus)|viutv\s*six|tvb\s*pearl|\bpearl\b|明珠台|英语|英語|英文|hoy\s+international\s+business"
)
SINGAPORE = r"(?iU)channel\s*(8|u)\b|8\s*频道|8頻道|u\s*频道|u頻道|华语|華語|中文"
BRANDS = r"(?iU)\b(brtv|btv|cetv|jstv|gdtv|grt|tvb|rthk|hoy|viutv|phoenix|鳳凰|凤凰|tdm|tvbs|ttv|ctv|cts|ftv|set|ebc|momo|ntd)\b"
CJK = r"[㐀-鿿぀-ヿ]"
PLACEHOLDER_HOSTS = ("t.freetv.fun", "epg.pw", "freetv.fun")
PLACEHOLDER_SUFFIX = ".freetv.fun"
RADIO = "广播电台|电台|广播|之声|radio| fm |fm-"
BROADCASTER = "广播电视|电视|频道"
PROGRAM_TITLE = r"(?i)第[一二三四五六七八九十百\d]+[季集期部]|[（(](上|下|完|\d+)[）)]$|(上|下)$"
CLEAR_STATION = r"(?iU)cctv|cgtn|卫视|频道|电视|\btv\b|news|newtv|sitv|cibn|chc|求索|剧场|影院"
STATION_WORDS = (
    "cctv|cgtn|央视|卫视|频道|电视|tv|news|新闻|卡通|少儿|纪录|电影|影院|剧场|动漫|体育|足球|篮球|网球|高尔夫|台球|戏曲|音乐|财经|法治|公共|都市|综合|经济|生活|科教|教育|文化|国际|中文"
    "|资讯|影视|娱乐|综艺|农业|农林|农民|健康|凤凰|chc|newtv|sitv|ihot|龙华|翡翠|无线|明珠|cnn|voa|4k|8k|cetv|brtv|btv|jstv|gdtv"
)
SCENIC = "(?i)iPanda|自然保护区|自然保護區|景区直播|景區直播|风景直播|風景直播|监控|監控"
FOREIGN_VARIANT = "(?i)CGTN.*(英语|英文|法语|法語|西语|西語|阿语|阿語|俄语|俄語)|「英文」|【英文】"
HANGUL = r"[가-힯]"
EPISODIC = "春晚|第一季|第二季|第三季|第四季|第五季|虎牙[-—]|斗鱼[-—]|斗魚[-—]"


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def placeholder_host(url: Column) -> Column:
    name = _said(urls.host(url))
    return name.isin(*PLACEHOLDER_HOSTS) | name.endswith(PLACEHOLDER_SUFFIX)


def viewer_verdict(name: Column, info: Column, group: Column, core: Column) -> Column:
    """``keep``, ``blocked_group``, ``foreign_service`` or ``language``; a group label alone is no evidence of language."""
    group = _said(group)
    shown = F.concat_ws(" ", _said(name), F.regexp_replace(_said(info), r'(?i)group-title="[^"]*"', ""))
    han = shown.rlike(CJK)
    return gate([
        (group.isin(*BLOCKED_GROUPS), "blocked_group"), (shown.rlike(ENGLISH), "foreign_service"), (F.coalesce(core, F.lit(False)), "keep"),
        ((group == "新加坡") & ~shown.rlike(SINGAPORE), "language"), ((group == "澳门") & ~han & ~shown.rlike(r"(?iU)\btdm\b"), "language"),
        (group.isin("新加坡", "台湾", "日本") | han | shown.rlike(BRANDS), "keep"),
    ], "language")


def station_verdict(name: Column, info: Column, url: Column, plus: Column, uhd: Column, mislabelled: Sequence[str] = (), rejected: Sequence[str] = ()) -> Column:
    """``station`` or why not. ``plus`` and ``uhd``: the label is the sports-events or the 4K channel."""
    name, info, url = _said(name), _said(info), _said(url)
    label, both, place = F.lower(name), F.lower(F.concat_ws(" ", name, info)), F.lower(urls.path(url))
    refused = F.lit(False)
    for prefix in rejected:
        refused = refused | url.startswith(prefix)
    return gate([
        (F.regexp_replace(url, "/+$", "").isin([m.rstrip("/") for m in mislabelled]) if mislabelled else F.lit(False), "mislabelled"), (refused, "user_rejected"),
        (urls.numbers_conflict(name, url), "number_conflict"), (place.contains("/audio/"), "audio_only"), (place.rlike("cctv5(p|plus)") & ~plus, "other_sports_route"),
        (F.lower(url).rlike(r"[?&]id=cctv4k\b|channel_cctv4k|/cctv4k([/?.]|$)") & ~uhd, "other_uhd_route"), (label.rlike(RADIO) & ~label.rlike(BROADCASTER), "radio"),
        (name.rlike(PROGRAM_TITLE) & ~both.rlike(CLEAR_STATION), "programme"), (info.rlike(r'(?i)tvg-(id|name|logo)="[^"]+"'), "station"), (both.rlike(STATION_WORDS), "station"),
    ], "unknown")


def lineup_verdict(name: Column, height: Column, on_demand: Column) -> Column:
    """``pass`` or why a verified row stays out of a stations-only line-up."""
    name = _said(name)
    return gate([
        (F.coalesce(height, F.lit(0)) < 720, "below720"), (F.coalesce(on_demand, F.lit(False)), "vod_or_loop"), (name.rlike(SCENIC), "scenic_or_camera"),
        (name.rlike(FOREIGN_VARIANT), "foreign_language_variant"), (name.rlike(HANGUL), "korean_station"), (name.rlike(EPISODIC), "not_station_like"),
    ])
