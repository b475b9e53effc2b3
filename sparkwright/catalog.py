"""All registered queries of the library, apart from the optional training-data operators."""

from __future__ import annotations

from sparkwright.plans import agreement, arrays, corpus, inference, learning, metrics, more, networks, relational, sequences, series, signals, stats, streams, tables, tests, text, vectors
from sparkwright.registry import REGISTRY

__all__ = ["ORACLE_SQL", "QUERIES", "agreement", "arrays", "corpus", "inference", "learning", "metrics", "more", "networks", "relational", "sequences", "series", "signals", "stats", "streams", "tables", "tests", "text", "vectors"]

QUERIES = REGISTRY.plans()
ORACLE_SQL = REGISTRY.sql()
