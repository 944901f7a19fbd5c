"""Queries by the identifiers of the coverage list; importing this package registers them."""

from evalloom.plans import analytics, cases, datasets, details, evaluation, feeds, ingestion, metrics, relational, retrieval, statistics, texts  # noqa: F401
from evalloom.plans.registry import ORACLES, QUERIES

# both forms of these do the whole job, so one SQL holds them
ORACLES.update({name: ORACLES[name.removesuffix("_all")] for name in QUERIES if name.endswith("_all") and name not in ORACLES})

__all__ = ["ORACLES", "QUERIES"]
