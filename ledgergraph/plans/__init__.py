"""Registered queries, each with the SQL that checks it where SQL can say it."""

from ledgergraph.plans.registry import CHECKS, QUERIES
from ledgergraph.plans import corrections, documents, graph, quality, status, text, validation  # noqa: F401

__all__ = ["CHECKS", "QUERIES"]
