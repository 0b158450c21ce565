"""Route scores and ordered gates as column expressions over measured metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.functions import urls
from lanewise.plans.policy import DEFAULT, Policy

H264 = ("h264", "avc", "avc1")


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def capped_sum(base: float, terms: Sequence[tuple[Column, float, float]], digits: int = 3) -> Column:
    """``base`` plus weight times the value, each value capped: (value, cap, weight)."""
    total = F.lit(base)
    for value, cap, weight in terms:
        total = total + F.least(_zero(value), F.lit(cap)) * weight
    return F.round(total, digits)


def evidence_score(height: Column, bitrate: Column, speed: Column, startup: Column) -> Column:
    return capped_sum(100000.0, [(height, 2160.0, 10.0), (bitrate, 30.0, 220.0), (speed, 100.0, 15.0), (startup, 30.0, -30.0)])


def fresh_score(status: Column, height: Column, bitrate: Column, speed: Column, startup: Column) -> Column:
    return F.when(status == "GOOD", evidence_score(height, bitrate, speed, startup)).otherwise(F.lit(-1e9))


def result_score(status: Column, height: Column, bitrate: Column, speed: Column, startup: Column, token: Column, weak: Column) -> Column:
    raw = capped_sum(100000.0, [(height, 2160.0, 8.0), (bitrate, 20.0, 180.0), (speed, 100.0, 12.0), (startup, 30.0, -25.0)], 6)
    return F.when(status == "GOOD", F.round(raw - F.when(token, 800).otherwise(0) - F.when(weak, 1200).otherwise(0), 2)).otherwise(F.lit(-1e9))


def weak_h264(codec: Column, mbps: Column, policy: Policy = DEFAULT) -> Column:
    return F.lower(F.coalesce(codec, F.lit(""))).isin(*H264) & (_zero(mbps) > 0) & (_zero(mbps) < policy.minimum_h264_mbps)


def required_speed(bandwidth_bps: Column, stream_mbps: Column, core: Column, policy: Policy = DEFAULT) -> Column:
    factor = F.when(core, policy.headroom_core).otherwise(policy.headroom_other)
    return F.greatest(F.lit(policy.minimum_speed_mbps), _zero(bandwidth_bps) / 1_000_000 * 1.25, _zero(stream_mbps) * factor)


def stable(ok: Column, height: Column, floor: Column, codec: Column, stream_mbps: Column, core: Column, mainland: Column, speed: Column, latency: Column, bandwidth: Column, rejected: Column, policy: Policy = DEFAULT) -> Column:
    """Fit to publish: measured, high enough, no false bitrate, and fast unless mainland."""
    picture = F.coalesce(ok, F.lit(False)) & ~F.coalesce(rejected, F.lit(False)) & (_zero(height) > 0) & (_zero(height) >= floor) & ~(core & weak_h264(codec, stream_mbps, policy))
    slow = F.coalesce(F.nullif(latency, F.lit(0.0)), F.lit(99.0))
    return picture & (mainland | ((slow <= policy.maximum_latency_s) & (_zero(speed) >= required_speed(bandwidth, stream_mbps, core, policy))))


def core_score(acceptable: Column, height: Column, stream_mbps: Column, checks: Column, history: Column, static: Column, mainland: Column, speed: Column, latency: Column) -> Column:
    mbps = _zero(stream_mbps)
    score = F.when(height >= 2160, 220.0).otherwise(160.0) + F.least(mbps, F.lit(12.0)) * 32 + F.least(F.coalesce(checks, F.lit(1)), F.lit(3)) * 20
    score = score + F.greatest(F.lit(-60.0), F.least(history, F.lit(90.0))) * F.when(mainland, 0.08).otherwise(0.30)
    score = score + F.greatest(F.lit(-80.0), F.least(static, F.lit(80.0))) * 0.10
    room = F.try_divide(_zero(speed), mbps)
    local = F.when(mbps > 0, F.when(room >= 1.5, 35).when(room < 1.35, -160).otherwise(0)).otherwise(0) - F.coalesce(F.nullif(latency, F.lit(0.0)), F.lit(10.0)) * 6
    return F.when(~acceptable | (height < 1080), F.lit(-9999.0)).otherwise(score + F.when(mainland, 0.0).otherwise(local))


def gate(rules: Sequence[tuple[Column, str]], passed: str = "pass") -> Column:
    """Name of the first rule that applies, in order."""
    outcome = F.lit(passed)
    for broken, name in rules[::-1]:
        outcome = F.when(broken, name).otherwise(outcome)
    return outcome


def quality_gate(height: Column, required: Column, core: Column, codec: Column, stream_mbps: Column, short_token: Column, low_variant: Column, suspect: Column, mainland: Column, headroom: Column, policy: Policy = DEFAULT) -> Column:
    floor = F.when(core, policy.gate_headroom_core).otherwise(policy.gate_headroom_other)
    return gate([
        (height < required, "fail_height"), (core & weak_h264(codec, stream_mbps, policy), "fail_fake_1080_bitrate"), (short_token, "fail_short_token"),
        (low_variant, "fail_unlocked_adaptive_master"), (suspect, "fail_suspected_identity"), (~mainland & (_zero(headroom) > 0) & (headroom < floor), "fail_headroom"),
    ])


def backup_order(headroom: str, startup: str, speed: str, height: str, fps: str, item: str) -> list[Column]:
    """Playback room first, then start-up and throughput; the id decides last."""
    return [F.coalesce(headroom, F.lit(0.0)).desc(), F.coalesce(startup, F.lit(0.0)), F.coalesce(speed, F.lit(0.0)).desc(), F.coalesce(height, F.lit(0)).desc(), F.coalesce(fps, F.lit(0.0)).desc(), F.col(item)]


def clearly_better(new: Column, old: Column, ratio: float = 1.15, margin: float = 0.0) -> Column:
    return _zero(new) >= F.greatest(_zero(old) * ratio, _zero(old) + margin)


def promotable(height: Column, fps: Column, scan: Column, headroom: Column, stream_mbps: Column, startup: Column) -> Column:
    """1080p50 or 1080i at 25 frames and above, with room to play."""
    smooth = (height >= 1080) & (((scan == "p") & (fps >= 49)) | ((scan == "i") & (fps >= 24.5)))
    return smooth & (_zero(headroom) * _zero(stream_mbps) >= F.greatest(F.lit(6.0), 1.35 * _zero(stream_mbps))) & (_zero(startup) <= 4)


# fixed values: points of a route before it is measured
STATIC_POINTS = {
    "preferred_host": 42, "unstable_host": -28, "edge_host": 190, "edge_url": 260, "operator_host": -90, "placeholder": -500, "part_time": -18, "low_value": -8,
    "chinese_group": 28, "han_name": 22, "headers": -8, "curated": 6, "preferred_route": 220, "public_pay": 28,
}


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def steps(value: Column, at_least: Sequence[tuple[float, float]], below: float = 0.0) -> Column:
    """Points of the first (bound, points) whose bound the value reaches, highest bound first."""
    found = F.lit(below)
    for bound, points in sorted(at_least):
        found = F.when(value >= bound, points).otherwise(found)
    return found


def static_score(url: Column, height: Column, signals: Mapping[str, Column], core: Column, satellite: Column, pay_group: Column) -> Column:
    """Points for the address, the labelled height and each signal of ``STATIC_POINTS`` that is given and true."""
    name, said = urls.host(url), urls.port(url)
    score = F.when(url.startswith("https://"), 26.0).otherwise(0.0) - F.when(name.rlike(r"^\d+\.\d+\.\d+\.\d+$"), 24).otherwise(0) - F.when(_yes(~said.isin(80, 443)), 12).otherwise(0)
    score = score + F.when(height > 1080, 25).when(height == 1080, 55).when(height == 720, 15).when((height > 0) & (height < 720), -16).otherwise(0)
    for signal, held in signals.items():
        score = score + F.when(held, STATIC_POINTS[signal]).otherwise(0)
    return score + F.when(core, 110).when(satellite, 55).when(pay_group, 35).otherwise(0)


def measured_score(static: Column, history: Column, ok: Column, geo: Column, duplicate: Column, speed: Column, latency: Column, height: Column, stream_mbps: Column, checks: Column, recheck_failed: Column, core: Column, ipv6: Column, dual: Column) -> Column:
    """Score of a probed route: picture, throughput, room to play, repeated checks, name resolution."""
    fast, mbps = F.least(_zero(speed), F.lit(40.0)), _zero(stream_mbps)
    clear, room = F.least(mbps, F.lit(12.0)), F.try_divide(fast, mbps)
    picture = F.when(height == 1080, 70).when(height == 720, 20).when(height > 1080, 25).when((height != 0) & (height < 720), -30).otherwise(0)
    of_core = F.when(mbps < 1.2, -130.0).when(room >= 1.5, clear * 25 + F.least(room, F.lit(3.0)) * 7).when(room >= 1.25, clear * 18).when(room >= 1.05, clear * 8 - 70).otherwise(-260.0)
    quality = F.when(mbps == 0, 0.0).when(core, of_core).otherwise(clear * 5 - F.when(room < 1.05, 70).otherwise(0))
    checked = F.when(_zero(checks) >= 2, 35).when(_yes(recheck_failed), -65).otherwise(0)
    slow = F.coalesce(F.nullif(latency.cast("double"), F.lit(0.0)), F.lit(10.0))
    base = static + history
    full = base + fast * F.when(core, 0.8).otherwise(2.2) - slow * 7 + checked + picture + quality + F.when(ipv6, 18).otherwise(0) + F.when(dual, 8).otherwise(0)
    return F.when(_yes(geo), base - 25).when(~_yes(ok) | _yes(duplicate), -9999.0).otherwise(full)


def mainland_score(static: Column, history: Column, usable: Column, geo: Column, height: Column, stream_mbps: Column, codec: Column, checks: Column, recheck_failed: Column, ipv6: Column, dual: Column) -> Column:
    """Score of a route measured from abroad: its speed says nothing, so picture and checks decide."""
    mbps, tall = _zero(stream_mbps), _zero(height)
    score = F.greatest(F.lit(-80.0), F.least(_zero(static), F.lit(80.0))) * 0.10 + F.greatest(F.lit(-60.0), F.least(_zero(history), F.lit(90.0))) * 0.08
    score = score + F.when(tall > 0, steps(tall, [(2160, 260.0), (1080, 190.0), (720, 80.0)], -120.0)).otherwise(-220.0)
    score = score + F.least(mbps, F.lit(12.0)) * 16 - F.when((tall >= 1080) & weak_h264(codec, mbps), 220).otherwise(0)
    score = score + F.when(_zero(checks) >= 2, steps(_zero(checks), [(3, 65.0)], 40.0)).when(_yes(recheck_failed), -70.0).otherwise(0.0)
    score = score + F.when(ipv6, 8).otherwise(0) + F.when(dual, 4).otherwise(0)
    return F.when(_yes(geo), -9000.0).when(~_yes(usable), -9999.0).otherwise(score)


def lineup_score(height: Column, bitrate: Column, speed: Column, startup: Column, codec: Column, sport: Column) -> Column:
    score = capped_sum(0.0, [(height, float("inf"), 100.0), (bitrate, 30.0, 250.0), (speed, 150.0, 8.0), (startup, 30.0, -30.0)], 6)
    return score + F.when(F.lower(codec).isin("hevc", "h265"), 250).otherwise(0) + F.when(sport, 100).otherwise(0)


# fixed values: points of picture, headroom and address in the route scores
PICTURE = [(1080, 500.0), (720, 100.0)]
HEADROOM = [(2.0, 70.0), (1.5, 50.0), (1.35, 30.0), (1.15, -90.0)]
THIN_PICTURE = [(1.8, 0.0), (1.2, -80.0)]
MODES = {"1080p50": 3000, "1080i50": 2700, "1080p25": 1800, "1080-other": 1500, "720p50": 1000, "720-other": 600}
RELAY_HOST = "2409:8087:"
RELAY_PATHS = r"/pltv/|/cms001/|/zte_cms/|/tvod/"
SIGNED = "accountinfo=|securitykey=|timestamp=|auth_key=|token="
UNUSABLE = -1e9


def _known(hint: Column, current: Column) -> Column:
    return F.when(_yes(hint), 20).otherwise(0) + F.when(_yes(current), 10).otherwise(0)


def fifty_frames_score(ok: Column, progressive: Column, height: Column, speed: Column, stream: Column, startup: Column, hint: Column, current: Column) -> Column:
    """Decoded frames first, then speed; a label only hints."""
    flow = F.least(_zero(speed), F.lit(40.0)) * 6 + F.least(_zero(stream), F.lit(15.0)) * 18 - _zero(startup) * 28
    score = F.when(_yes(progressive), 1400.0).otherwise(0.0) + steps(_zero(height), PICTURE, 0.0) + flow + _known(hint, current)
    return F.when(_yes(ok), score).otherwise(UNUSABLE)


def fifty_fields_score(ok: Column, progressive: Column, interlaced: Column, height: Column, speed: Column, stream: Column, startup: Column, hint: Column, current: Column) -> Column:
    """Like ``fifty_frames_score`` with interlaced pictures too; given headroom, the picture's rate counts."""
    rate = _zero(stream)
    mode = F.when(_yes(progressive), 1550.0).when(_yes(interlaced), 1400.0).otherwise(0.0)
    room = F.when(rate != 0, steps(_zero(speed) / rate, HEADROOM, -320.0) + steps(rate, THIN_PICTURE, -160.0)).otherwise(0.0)
    score = mode + steps(_zero(height), PICTURE, 0.0) + F.least(rate, F.lit(12.0)) * 32 + F.least(_zero(speed), F.lit(20.0)) * 1.8 + room - _zero(startup) * 28 + _known(hint, current)
    return F.when(_yes(ok), score).otherwise(UNUSABLE)


def ipv6_score(url: Column, weight: Column, sources: Column) -> Column:
    """Preference among unmeasured IPv6 routes: sources that agree, relay addresses, no signed query."""
    low = F.lower(url)
    said = F.greatest(F.lit(0.0), _zero(sources) - 1) * 40 + F.when(F.startswith(urls.host(url), F.lit(RELAY_HOST)), 18).otherwise(0)
    return _zero(weight) + said + F.when(low.rlike(RELAY_PATHS), 10).otherwise(0) - F.when(low.rlike(SIGNED), 24).otherwise(0) + F.when(low.contains("love=freedom"), 4).otherwise(0)


def rotation_score(height: Column, fps: Column, stream: Column, bitrate: Column, segment: Column, startup: Column, references: Column, reused_host: Column) -> Column:
    """A candidate's worth in the rotation; the stream's rate, or what was announced where that is 0."""
    rate = F.coalesce(F.nullif(_zero(stream), F.lit(0.0)), _zero(bitrate))
    flow = F.when(rate > 0, F.least(rate, F.lit(20.0)) * 40).otherwise(-20.0)
    score = F.least(_zero(height), F.lit(2160.0)) * 10 + F.when(_zero(fps) >= 45, 5).otherwise(0) + flow + F.least(_zero(segment), F.lit(12.0)) * 2
    return F.round(score - F.least(_zero(startup), F.lit(10.0)) * 10 + F.least(_zero(references), F.lit(8.0)) * 2 - F.when(_yes(reused_host), 8).otherwise(0), 3)


def mode_score(ok: Column, mode: Column, download: Column, second_download: Column, stream: Column, startup: Column) -> Column:
    """Picture mode, then the slower of two downloads (a second of 0 was not made)."""
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair]), mode), F.lit(0))
    slower = F.least(_zero(download), F.coalesce(F.nullif(_zero(second_download), F.lit(0.0)), _zero(download)))
    return F.when(_yes(ok), bonus + F.least(slower, F.lit(50.0)) * 8 + F.least(_zero(stream), F.lit(20.0)) * 20 - _zero(startup) * 50).otherwise(UNUSABLE)


def easy_ready(fit: Column, checks: Column, failed: Column, geo: Column, mainland: Column, recent: Column) -> Column:
    """Three fresh checks; unless mainland, also three in four of a history of four or more."""
    share = F.aggregate(recent, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(recent), F.lit(0))
    return _yes(fit) & (_zero(checks) >= 3) & ~_yes(failed) & ~_yes(geo) & (_yes(mainland) | ~_yes((F.size(recent) >= 4) & (share < 0.75)))


def family_core_usable(acceptable: Column, checks: Column, recheck_failed: Column, geo: Column) -> Column:
    return _yes(acceptable) & (_zero(checks) >= 2) & ~_yes(recheck_failed) & ~_yes(geo)


def hd_pass(ok: Column, height: Column, stream_mbps: Column, first: Column, second: Column, startup: Column, strict: bool) -> Column:
    """1080 lines or more, below 2160, with room in the slower of two downloads (no second: the first)."""
    least, factor, rate = (7.0, 1.2, 5.0) if strict else (5.0, 1.5, 2.5)
    slower = F.least(_zero(first), F.coalesce(F.nullif(second.cast("double"), F.lit(0.0)), _zero(first)))
    return _yes(ok) & (_zero(height) >= 1080) & (_zero(height) < 2160) & (_zero(stream_mbps) >= rate) & (slower >= F.greatest(F.lit(least), _zero(stream_mbps) * factor)) & (_zero(startup) <= 2.0)


def household_status(observed: Column, deep: Column, samples: Column, sample_bytes: Column, stream_mbps: Column, download: Column, codec: Column, height: Column, min_height: Column, accepted: Column, hevc: float = 2.5, other: float = 3.0) -> Column:
    """Status derived again from the evidence; rows that were no success keep theirs.

    A success needs two samples, each of 65,536 to ``sample_bytes`` bytes in 0.001 to 30 seconds; anything else is an error.
    """
    rate = _zero(stream_mbps)
    whole = (F.size(samples) == 2) & F.forall(samples, lambda s: s["downloaded_bytes"].between(F.lit(65536), sample_bytes) & s["elapsed_s"].between(0.001, 30.0))
    poor = (_zero(height) < min_height) | (rate < F.when(F.lower(codec).isin("hevc", "h265"), hevc).otherwise(other))
    derived = F.when(~_yes(deep) | (rate <= 0), "UNKNOWN").when((F.try_divide(_zero(download), rate) < 1.05) | (poor & ~_yes(accepted)), "DEGRADED").otherwise("GOOD")
    success = observed.isin("GOOD", "DEGRADED")
    return F.when(success & ~_yes(whole), F.raise_error(F.lit("successful measurement lacks two whole samples")).cast("string")).when(success, derived).otherwise(observed)
