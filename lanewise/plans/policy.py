"""All thresholds of selection, health and publication in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    minimum_h264_mbps: float = 2.0
    headroom_core: float = 1.35
    headroom_other: float = 1.20
    gate_headroom_core: float = 1.5
    gate_headroom_other: float = 1.35
    maximum_latency_s: float = 5.0
    minimum_speed_mbps: float = 2.2
    dead_after_runs: int = 3
    dead_min_age_hours: float = 6.0
    circuit_min_unknown: int = 20
    circuit_unknown_ratio: float = 0.25
    mass_min_keys: int = 5
    mass_failure_ratio: float = 0.5
    host_veto_urls: int = 2
    backup_ttl_hours: float = 36.0
    backups_per_key: int = 8
    report_max_hours: float = 18.0
    reports_kept: int = 40
    checkpoint_reuse_hours: float = 6.0
    history_kept: int = 12
    labels_kept: int = 20
    daily_target: int = 500
    daily_amount: int = 1536 * 1024 * 1024
    daily_seconds: int = 3600
    daily_candidates: int = 10
    discovery_amount: int = 256 * 1024 * 1024
    discovery_seconds: int = 600
    leased_s: int = 1800
    snapshots_kept: int = 5


DEFAULT = Policy()
