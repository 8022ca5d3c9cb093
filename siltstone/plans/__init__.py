"""Registered queries over the test tables, by the operators' names."""

from __future__ import annotations

from siltstone.plans import corpus, files, relational, retrieval, scalars, segments, services
from siltstone.plans.registry import ORACLES, QUERIES

FLAGSHIP = QUERIES[retrieval.FLAGSHIP]

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "corpus", "files", "relational", "retrieval", "scalars", "segments", "services"]
