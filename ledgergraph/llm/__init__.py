"""Operators for training-data pipelines: sharding, dedup, packing, scoring, decontamination, token files and counts.

Nothing outside this subpackage imports it. ``QUERIES`` and ``CHECKS`` in :mod:`ledgergraph.llm.queries` list its queries.
"""
