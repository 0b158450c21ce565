"""Importing this module registers every query."""

from __future__ import annotations

from lanewise.plans import pipelines, queries_aggregates, queries_folds, queries_joins, queries_promotion, queries_queues, queries_ranking, queries_rules, queries_states, queries_storage, queries_text  # noqa: F401
from lanewise.plans.registry import ORACLES, QUERIES  # noqa: F401
