"""Registered queries: each operator over the given tables, with the SQL that must give the same rows."""

from plumbline.suite import (  # noqa: F401  (importing registers the queries)
    details, evaluation, governance, labels, responses, reviews, rounds, scoring, sources, statistics, streams, validation,
)
from plumbline.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
