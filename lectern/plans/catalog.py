"""All registered queries. Importing the query modules fills the registry."""

from __future__ import annotations

from . import chat_queries, corpus_queries, panel_queries, retrieval_queries  # noqa: F401
from .registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
