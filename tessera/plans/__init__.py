"""Queries over the standard tables, by family, each beside its SQL."""

from tessera.plans import basics, builds, evaluation, imports, ingestion, matching, models, operations, pricing, retrieval, review  # noqa: F401
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
