"""All registered driver queries (importing the modules fills the registry)."""

from __future__ import annotations

from lexiscope.plans import (  # noqa: F401
    catalog_clusters, catalog_concepts, catalog_methods, catalog_pairs, catalog_sources, catalog_words,
)
from lexiscope.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
