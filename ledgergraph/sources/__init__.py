"""Readers, writers and the bindings of the star-schema tables to graph tables."""
