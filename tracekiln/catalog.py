"""All registered queries and their oracle SQL."""

from __future__ import annotations

from .plans import registry
from .plans import q_answers, q_curation, q_pairs, q_profile, q_more, q_retrieval, q_scoring, q_sources, q_streaming  # noqa: F401  (registration side effects)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
