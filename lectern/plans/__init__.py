"""Whole pipelines, and the registry of checkable queries over the given tables."""
